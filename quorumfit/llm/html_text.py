"""Main text of web pages by wrappers inferred from the pages of each host."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumfit.llm.tables import attach_groups, written
from quorumfit.llm.words import slices

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Elements whose content is no text.
RAW = frozenset("script style noscript template svg iframe object canvas textarea".split())
#: Elements inside a block; their tags leave no trace in the stream.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
#: Elements that end where the next of their kind, or the end of what holds them, comes.
CLOSES = {
    "p": frozenset("p".split()), "li": frozenset("li p".split()), "dt": frozenset("dt dd p".split()),
    "dd": frozenset("dt dd p".split()), "tr": frozenset("tr td th p".split()),
    "td": frozenset("td th p".split()), "th": frozenset("td th p".split()),
    "option": frozenset("option".split()),
}
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol pre section table ul".split()
)
#: Regions that are no main text, by element, and by a word of class, id or role.
FURNITURE = frozenset(
    "head title nav footer aside form button select dialog menu".split()
)
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead banner ad ads "
    "advert adverts advertisement sponsored sponsor promo promoted cookie cookies consent notice notices "
    "alert popup modal newsletter subscribe signup login search form comment comments reply replies "
    "disqus discussion related recommended share sharing social widget pagination copyright "
    "complementary contentinfo dialog".split()
)
#: Those of them that may hold more text than a short article.
LONG_WORDS = frozenset(
    "nav navbar navigation menu comment comments reply replies disqus discussion related recommended".split()
)
MAIN = frozenset("article main".split())
MAIN_WORDS = frozenset("article post entry story main content".split())

#: Elements that pages of one template have or lack.
CONTENT = frozenset(
    "p h1 h2 h3 h4 h5 h6 hr ul ol dl table blockquote pre figure address details picture video audio".split()
)

LONGEST_GROUP = 12
#: Elements nested deeper leave no tags in the stream; those that are furniture leave no text.
DEEPEST = 100
#: What a form must hold to be the frame of a page.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 article main blockquote pre".split())


def _signature(tag: str, attributes: str) -> str:
    """Tag with the words of class, id and role, without digits."""
    words = set()
    for m in NAMED.finditer(attributes) if "=" in attributes else ():
        value = next(v for v in m.groups()[1:] if v is not None)
        words |= set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    return ".".join([tag, *sorted(words)])


def stream(page: str) -> tuple[list[str], list[str]]:
    """Token stream of a page: tags, and ``#`` for each text; and the texts.

    Comments, declarations and content of ``RAW`` elements are skipped, inline tags vanish,
    implied ends of paragraphs, items and cells are added, a markup cut off at the end of the
    page is dropped. References are decoded; white space in a text is one space.
    """
    out: list[str] = []
    texts: list[str] = []
    open_tags: list[str] = []
    piece: list[str] = []
    hidden: list[int] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(piece)).split()) if piece else ""
        piece.clear()
        if text and not hidden:
            out.append("#")
            texts.append(text)

    def close(upto: int) -> None:
        while len(open_tags) > upto:
            name = open_tags.pop().split(".", 1)[0]
            if len(open_tags) < DEEPEST:
                out.append("/" + name)
            elif hidden and hidden[-1] == len(open_tags):
                hidden.pop()

    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            piece.append(page[at:])
            break
        piece.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                stop = re.compile(f"</{re.escape(tag)}(?=[\\s>/]|\\Z)", re.I).search(page, at)
                at = stop.start() if stop else end
            continue
        if tag in INLINE:
            continue
        if tag == "br":
            piece.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k].split(".", 1)[0] == tag:
                    close(k)
                    break
            continue
        ends = CLOSES.get(tag, frozenset()) | (frozenset(("p",)) if tag in ENDS_P else frozenset())
        while open_tags and open_tags[-1].split(".", 1)[0] in ends:
            close(len(open_tags) - 1)
        name = _signature(tag, m[3])
        if len(open_tags) < DEEPEST:
            out.append(name)
        elif _names_furniture(name):
            hidden.append(len(open_tags))
        open_tags.append(name)
    flush()
    close(0)
    return out, texts


def tree(tokens: list[str]) -> list:
    """Nested items of a stream: "#" or [tag, items]."""
    root: list = []
    levels = [root]
    for token in tokens:
        if token == "#":
            levels[-1].append(token)
        elif token[0] == "/":
            levels.pop()
        else:
            item = [token, []]
            levels[-1].append(item)
            levels.append(item[1])
    return root


# A wrapper is a union-free expression: a list of items [kind, tag, items, quantifier].
# kind is "#" (a text slot) or "e" (an element); quantifier "1", "?" (optional) or "+"
# (repeated). Items of an optional or repeated element belong to the group.


def expression(nested: list) -> list:
    """Expression of one page; like neighbours fold into a repeated group."""
    items: list = []
    for item in nested:
        if item == "#":
            new = ["#", "#", [], "1"]
        else:
            new = ["e", item[0], expression(item[1]), "1"]
        if items and items[-1][1] == new[1]:
            items[-1] = [new[0], new[1], align(items[-1][2], new[2]), "+"]
        else:
            items.append(new)
        for width in range(2, min(LONGEST_GROUP, len(items) // 2) + 1):
            if [i[1] for i in items[-width:]] == [i[1] for i in items[-2 * width : -width]]:
                second = items[-width:]
                del items[-width:]
                for k, later in zip(range(-width, 0), second):
                    items[k] = [later[0], later[1], align(items[k][2], later[2]), "+"]
                break
    return items


def align(a: list, b: list) -> list:
    """Expression that covers both: like items in order meet, the others become optional."""
    if a == b:
        return a
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            same = rows[i + 1][j + 1] + 1 if a[i][1] == b[j][1] else -1
            rows[i][j] = max(same, rows[i + 1][j], rows[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i][1] == b[j][1] and rows[i][j] == rows[i + 1][j + 1] + 1:
            kinds = {a[i][3], b[j][3]}
            many = "+" if "+" in kinds else "?" if "?" in kinds else "1"
            out.append([a[i][0], a[i][1], align(a[i][2], b[j][2]), many])
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return out + [_optional(x) for x in a[i:]] + [_optional(x) for x in b[j:]]


def _optional(item: list) -> list:
    return [*item[:3], "?" if item[3] == "1" else item[3]]


def slots(wrapper: list, path: tuple = ()) -> Iterator[tuple]:
    """Paths of the text slots of a wrapper, in order."""
    for k, item in enumerate(wrapper):
        if item[0] == "#":
            yield (*path, "#")
        else:
            yield from slots(item[2], (*path, item[1]))


def places(nested: list, path: tuple = ()) -> Iterator[tuple]:
    """Slot path of each text of a page, in page order."""
    for item in nested:
        if item == "#":
            yield (*path, "#")
        else:
            yield from places(item[1], (*path, item[0]))


def _names_furniture(name: str) -> bool:
    tag, *words = name.split(".")
    return tag in FURNITURE or bool(FURNITURE_WORDS.intersection(words))


def holders(found: list[tuple[tuple, str]]) -> frozenset[tuple]:
    """Paths of elements that hold the page's article or most of its text.

    Words of class, id or role say nothing about them ("has-sidebar", "no-comments"), and a
    form around the page is no form: one that holds nine tenths of what is not named as
    furniture, prose among it. Menus and comments may hold most of a page, so what is
    named like them must be named as content, too, or hold nine tenths. Text in furniture
    elements does not count.
    """
    sizes: dict[tuple, int] = {}
    whole, loose, out, prose = 0, 0, set(), set()
    for path, text in found:
        tags = [name.split(".", 1)[0] for name in path[:-1]]
        if any(t in FURNITURE and t != "form" for t in tags):
            continue
        whole += len(text)
        if not any(_names_furniture(n) for n, t in zip(path, tags) if t not in ("html", "body", "form")):
            loose += len(text)
        for k in range(1, len(path)):
            sizes[path[:k]] = sizes.get(path[:k], 0) + len(text)
            if any(tag in PROSE for tag in tags[k:]):
                prose.add(path[:k])
        for k, tag in enumerate(tags):
            if tag in MAIN and not _names_furniture(path[k]):
                out.update(path[:n] for n in range(1, k + 1))
    for path, size in sizes.items():
        tag, *words = path[-1].split(".")
        words = set(words)
        if tag == "form" and not (path in prose and 10 * size > 9 * loose):
            continue
        named = not words & LONG_WORDS or words & (MAIN_WORDS - {"main"})
        if 10 * size > 9 * whole or (named and 2 * size > whole):
            out.add(path)
    return frozenset(out)


def furniture(path: tuple, held: frozenset[tuple] = frozenset(), words: bool = True) -> bool:
    """Whether a slot lies in a region that is no main text.

    Words of ``html``, ``body`` and of the elements ``held`` do not count; with ``words``
    false, no words do.
    """
    inside = False
    for k, name in enumerate(path[:-1]):
        tag = name.split(".", 1)[0]
        plain = not words or tag in ("html", "body") or path[: k + 1] in held
        frame = tag == "form" and path[: k + 1] in held
        if (tag in FURNITURE and not frame) if plain else _names_furniture(name):
            return True
        if tag == "header" and not inside:
            return True
        inside |= tag in MAIN
    return False


def rank(slot: tuple) -> int:
    """0 for slots inside ``article`` or ``main``, 1 inside what is named as content, else 2."""
    names = [p.split(".") for p in slot]
    if any(n[0] in MAIN for n in names):
        return 0
    return 1 if any(MAIN_WORDS.intersection(n[1:]) for n in names if n[0] not in ("html", "body")) else 2


def main_parts(nested: list, texts: list[str]) -> list[tuple[tuple, str]]:
    """(slot, text) of the best ranked slots that a page has outside furniture, in page order.

    Where the words of furniture leave nothing, elements alone decide.
    """
    found = list(zip(places(nested), texts))
    held = holders(found)
    clear = [f for f in found if not furniture(f[0], held)]
    if not clear:
        clear = [f for f in found if not furniture(f[0], held, words=False)]
    ranks = [rank(slot) for slot, _ in clear]
    return [f for f, r in zip(clear, ranks) if r == min(ranks)]


def template(nested: list) -> str:
    """Name of the page's template: body and the elements in it that are no furniture or text."""
    items, path = nested, []
    while True:
        below = [i for i in items if i != "#" and i[0].split(".", 1)[0] in ("html", "body")]
        if not below:
            break
        path.append(below[0][0])
        items = [i for item in below for i in item[1]]
    names = {
        i[0] for i in items
        if i != "#" and i[0].split(".", 1)[0] not in CONTENT and not _names_furniture(i[0])
    }
    return hashlib.md5("\n".join([*path, "", *sorted(names)]).encode()).hexdigest()


def host_of(url: Column) -> Column:
    """Host of an address in lower case; null or without one: empty."""
    return F.coalesce(
        F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)),
        F.lit(""),
    )


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper a host and template for every task: pages with equal expressions align once."""
    known: dict[tuple, list] = {}
    for batch in (part for whole in batches for part in slices(whole, "html")):
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            nested = tree(stream(page or "")[0])
            key = (host, template(nested))
            found = expression(nested)
            known[key] = align(known[key], found) if key in known else found
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([h for h, _ in known], pa.string()), pa.array([t for _, t in known], pa.string()),
            pa.array([json.dumps(w) for w in known.values()], pa.string()),
        ],
        ["host", "template", "wrapper"],
    )


def _join_wrappers(frame: pd.DataFrame) -> pd.DataFrame:
    wrapper = reduce(align, (json.loads(w) for w in sorted(frame["wrapper"])))
    first = frame.iloc[0]
    return pd.DataFrame({
        "host": [first["host"]], "template": [first["template"]], "part": [int(first["part"])],
        "wrapper": [json.dumps(wrapper)],
    })


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, template, wrapper of every template of every host of ``pages`` (host, html).

    Tasks align the pages they hold, template by template; the wrappers of a template meet in
    two rounds (1,024 parts, then one), so a host of any size is never one task's work.
    """
    parts = pages.select("host", "html").mapInArrow(_infer, "host string, template string, wrapper string")
    spread = parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(1024)).cast("int"))
    shape = "host string, template string, part int, wrapper string"
    first = spread.groupBy("host", "template", "part").applyInPandas(_join_wrappers, shape)
    return first.groupBy("host", "template").applyInPandas(_join_wrappers, shape).drop("part")


PART = "array<struct<slot:string,text:string>>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "html")):
        rows, templates = [], []
        for page in batch.column("html").to_pylist():
            tokens, texts = stream(page or "")
            nested = tree(tokens)
            templates.append(template(nested))
            rows.append([
                {"slot": slot, "text": " ".join(t for _, t in run)}
                for slot, run in groupby(
                    ((" ".join(s), t) for s, t in main_parts(nested, texts)), key=lambda f: f[0]
                )
            ])
        kind = pa.list_(pa.struct([("slot", pa.string()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"), batch.column("url"), batch.column("host"),
                pa.array(templates, pa.string()), pa.array(rows, kind),
            ],
            ["page_id", "url", "host", "template", "parts"],
        )


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each slot, as digests and sizes, of pages without an ``article`` or ``main`` slot."""
    kind = pa.list_(pa.struct([
        ("rank", pa.int32()), ("slot", pa.string()), ("whole", pa.string()), ("digest", pa.string()),
        ("chars", pa.int64()),
    ]))
    for batch in (part for whole in batches for part in slices(whole, "html")):
        hosts, templates, bodies, rows = [], [], [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            tokens, texts = stream(page or "")
            nested = tree(tokens)
            seen: dict[tuple, list] = {}
            for slot, text in main_parts(nested, texts):
                seen.setdefault(slot, []).append(text)
            if not seen or rank(next(iter(seen))) == 0:
                continue
            whole = {s: _digest("\n".join(t)) for s, t in seen.items()}
            facts = [
                {
                    "rank": rank(s), "slot": " ".join(s), "whole": whole[s], "digest": _digest(t),
                    "chars": len(t),
                }
                for s, ts in seen.items() for t in dict.fromkeys(ts)
            ]
            hosts.append(host)
            templates.append(template(nested))
            bodies.append(_digest("".join(" ".join(s) + d for s, d in whole.items())))
            rows.append(facts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(templates, pa.string()), pa.array(bodies, pa.string()),
             pa.array(rows, kind)],
            ["host", "template", "body", "facts"],
        )


def constant_slots(pages: DataFrame) -> DataFrame:
    """host, template, constant: the slots that hold boilerplate.

    Copies of a page count once. Such a slot is on nine tenths of a template's different pages
    and on three or more, always with the same text, and what differs on these pages, each
    text counted once, is at least as long as what is the same. So neither a part that only
    copies of one page have, nor the body of copies with another date is boilerplate.
    """
    kind = "array<struct<rank:int,slot:string,whole:string,digest:string,chars:bigint>>"
    facts = pages.select("host", "html").mapInArrow(
        _facts, f"host string, template string, body string, facts {kind}"
    )
    key = ["host", "template", "rank"]
    bodies = facts.groupBy("host", "template", "body").agg(F.first("facts").alias("facts"))
    texts = bodies.select("host", "template", F.explode("facts").alias("f")).select(
        "host", "template", "f.*"
    )
    sizes = bodies.withColumn("rank", F.col("facts")[0]["rank"]).groupBy(*key).agg(F.count("*").alias("pages"))
    slots_of = (
        texts.groupBy(*key, "slot", "digest").agg(
            F.count("*").alias("n"), F.first("chars").alias("chars"),
            F.min("whole").alias("low"), F.max("whole").alias("high"),
        )
        .groupBy(*key, "slot").agg(
            F.max("n").alias("n"), F.sum("chars").alias("chars"),
            (F.min("low") == F.max("high")).alias("one"),
        )
    )
    marked = slots_of.join(sizes, key).withColumn(
        "same", F.col("one") & (F.col("n") >= 3) & (10 * F.col("n") >= 9 * F.col("pages"))
    )
    return (
        marked.groupBy(*key, "pages").agg(
            F.sum(F.when(~F.col("same"), F.col("chars")).otherwise(0)).alias("differs"),
            F.sum(F.when(F.col("same"), F.col("chars")).otherwise(0)).alias("stays"),
            F.collect_list(F.when(F.col("same"), F.col("slot"))).alias("constant"),
        )
        .where((F.size("constant") > 0) & (F.col("differs") >= F.col("stays") * F.col("pages")))
        .groupBy("host", "template").agg(F.flatten(F.collect_list("constant")).alias("constant"))
    )


def _mains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            list(dict.fromkeys(" ".join(s) for s in slots(json.loads(w))))
            for w in batch.column("wrapper").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("template"), pa.array(found, pa.list_(pa.string()))],
            ["host", "template", "mains"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    The pages of a host that share a template are aligned into its wrapper: a regular
    expression of elements without alternatives, in which what some pages lack is optional,
    what repeats is a repeated group, and texts are slots. Each page gives the texts of its
    best slots outside furniture (inside ``article`` or ``main``, else inside elements named
    as content, else all) in page order, joined by a space; without ``article`` and ``main``
    the wrapper's slots of boilerplate are left out, unless the page has nothing else. Only
    these texts move, and hot hosts are split into salted parts.

    Null html is an empty page and has the empty text; pages without a host are one host;
    repeated rows stay rows; other columns are ignored. Unclosed and cut-off markup is read
    as browsers do where that is simple (implied ends), else dropped.
    """
    plain = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    key = ["host", "template"]
    wrappers = infer_wrappers(plain).mapInArrow(_mains, "host string, template string, mains array<string>")
    mains = written(
        wrappers.join(constant_slots(plain), key, "left").select(
            *key, F.array_except("mains", F.coalesce("constant", F.array().cast("array<string>"))).alias("mains")
        ),
        "wrappers",
    )
    kind = dict(plain.dtypes)["page_id"]
    parts = plain.mapInArrow(
        _parts, f"page_id {kind}, url string, host string, template string, parts {PART}",
    )
    joined = attach_groups(parts, mains, key, F.hash("page_id", "url"))
    own = F.filter("parts", lambda p: F.array_contains("mains", p["slot"]))
    wanted = F.when(F.size(own) > 0, own).otherwise(F.col("parts"))
    text = F.array_join(F.transform(wanted, lambda p: p["text"]), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
