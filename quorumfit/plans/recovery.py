"""Progress of a fit, kept so that another session can go on from its last whole round."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from quorumfit.session import hadoop_path

_NAME = "round-"


@dataclass
class Progress:
    """What the next round needs: the global vector, the penalty, the states' table and the
    trace so far. ``before`` has z and the penalty that the states were solved with and the
    pull of the regulariser, for the spectral penalty."""

    layout: dict
    iteration: int
    z: list[float]
    rho: float
    dual_scale: float
    before: dict
    trace: list[list]
    state_path: str
    chunks_path: str | None
    converged: bool


class Journal:
    """A folder in shared storage with one manifest a round.

    A manifest is written beside its place and renamed into it, after the states' table of
    its round is complete; only then the round before is deleted. So the newest manifest
    names tables that are there, wherever a fit stopped.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, label: str) -> str:
        """A new path below the folder."""
        return f"{self.folder}/{label}-{uuid.uuid4().hex}"

    def _rounds(self) -> list[str]:
        target, files = hadoop_path(self.spark, self.folder)
        if not files.exists(target):
            return []
        names = [status.getPath().getName() for status in files.listStatus(target)]
        return sorted(n for n in names if n.startswith(_NAME) and n.endswith(".json"))

    def latest(self) -> Progress | None:
        rounds = self._rounds()
        if not rounds:
            return None
        text = self.spark.read.text(f"{self.folder}/{rounds[-1]}", wholetext=True).first()[0]
        return Progress(**json.loads(text))

    def tidy(self, progress: Progress) -> None:
        """Delete what a round that did not end has left."""
        keep = {path.rsplit("/", 1)[-1] for path in (progress.state_path, progress.chunks_path) if path}
        target, files = hadoop_path(self.spark, self.folder)
        for status in files.listStatus(target):
            name = status.getPath().getName()
            if name not in keep and name.startswith(("state-", "chunks-", "draft-")):
                self.delete(f"{self.folder}/{name}")

    def save(self, progress: Progress) -> None:
        """Make this round the newest and forget the ones before."""
        older = self._rounds()
        name = f"{_NAME}{progress.iteration:09d}.json"
        draft, files = hadoop_path(self.spark, self.path("draft"))
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(asdict(progress)).encode()))
        out.close()
        final, _ = hadoop_path(self.spark, f"{self.folder}/{name}")
        if not files.rename(draft, final):
            raise OSError(f"{final.toString()} is there already: another fit uses this folder")
        for old in older:
            self.delete(f"{self.folder}/{old}")

    def delete(self, path: str) -> None:
        if not path.startswith(f"{self.folder}/"):
            raise ValueError(f"not in the journal: {path}")
        target, files = hadoop_path(self.spark, path)
        files.delete(target, True)
