"""The durable state of a merge: sources, positions and stop point.

Every change writes a whole new version, ``manifest/v<number>.json``, beside its
place and renames it there.  A name that is taken means that another process
has committed since this state was read: the writer gets ``ManifestConflict``
and nothing is lost.  Readers take the newest version, which is always whole.
"""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from keyspan.sources.files import delete, names_in, read_text, write_new_text

ACTIVE, PAUSED, REMOVED = "active", "paused", "removed"
KEPT_VERSIONS = 20


class ManifestConflict(RuntimeError):
    pass


@dataclass
class Source:
    path: str
    state: str = ACTIVE
    position: object = None              # largest sequence committed to the sink


def _plain(x):
    """Sequences are numbers, strings, dates or timestamps."""
    if isinstance(x, datetime.datetime):
        return {"timestamp": x.isoformat()}
    if isinstance(x, datetime.date):
        return {"date": x.isoformat()}
    return x


def _typed(x):
    if isinstance(x, dict) and len(x) == 1:
        if "timestamp" in x:
            return datetime.datetime.fromisoformat(x["timestamp"])
        if "date" in x:
            return datetime.date.fromisoformat(x["date"])
    return x


@dataclass
class Manifest:
    version: int = 0
    stop_at: object = None
    sources: dict[str, Source] = field(default_factory=dict)
    _read: str = ""

    @staticmethod
    def load(spark: SparkSession, root: str) -> Manifest:
        versions = _versions(spark, root)
        if not versions:
            return Manifest()
        text = read_text(spark, f"{_folder(root)}/{_name(versions[-1])}")
        doc = json.loads(text)
        sources = {n: Source(s["path"], s["state"], _typed(s["position"])) for n, s in doc["sources"].items()}
        return Manifest(doc["version"], _typed(doc["stop_at"]), sources, _text(doc["stop_at"], doc["sources"]))

    def _body(self) -> tuple[object, dict]:
        return _plain(self.stop_at), {n: asdict(s) | {"position": _plain(s.position)} for n, s in self.sources.items()}

    @property
    def changed(self) -> bool:
        return _text(*self._body()) != self._read

    def commit(self, spark: SparkSession, root: str) -> None:
        stop_at, sources = self._body()
        body = json.dumps({"version": self.version + 1, "stop_at": stop_at, "sources": sources}, indent=1)
        try:
            write_new_text(spark, f"{_folder(root)}/{_name(self.version + 1)}", body)
        except FileExistsError as e:
            raise ManifestConflict(f"{root}: version {self.version + 1} was committed by another process") from e
        self.version += 1
        self._read = _text(stop_at, sources)
        for old in _versions(spark, root)[:-KEPT_VERSIONS]:
            delete(spark, f"{_folder(root)}/{_name(old)}")


def _text(stop_at, sources) -> str:
    return json.dumps([stop_at, sources], sort_keys=True)


def _folder(root: str) -> str:
    return f"{root.rstrip('/')}/manifest"


def _name(version: int) -> str:
    return f"v{version:012d}.json"


def _versions(spark: SparkSession, root: str) -> list[int]:
    found = [re.fullmatch(r"v(\d+)\.json", n) for n in names_in(spark, _folder(root))]
    return sorted(int(m[1]) for m in found if m)
