"""The log of a store's versions: what each one consists of, switched by one atomic step.

A store is a folder. Loads add folders of Parquet files (``segments``), which never change once written, and end
by writing ``_versions/<number>.json``: the names of all segments that make up the new version, and its scalars. The
file gets its name by a rename that fails if the name is taken, so a version exists whole or not at all, and of
two loads that start from one version only one can end. Readers pick the last version and then read only its segments;
whoever started before a load keeps reading the version it began with.
"""

from __future__ import annotations

import dataclasses
import json
import time

from pyspark.sql import SparkSession

from ragtide.sources import paths

#: Kinds of segments, each a folder of the store.
KINDS = ("passages", "removed", "documents", "ids", "terms")


class VersionTaken(RuntimeError):
    """Another load ended first; run this one again."""


@dataclasses.dataclass(frozen=True)
class Version:
    """Segment folders by kind, relative to the store's, and the scalars of one version."""

    number: int = 0
    key_type: str = "bigint"  # SQL type of the documents' keys
    passages: tuple[str, ...] = ()  # rows with the number of the load that brought them
    removed: tuple[str, ...] = ()  # (doc_key, gone): rows of the document from loads before ``gone`` are no longer there
    documents: tuple[str, ...] = ()  # (doc_key, n, s, x, load): what the document consisted of as of that load
    ids: tuple[str, ...] = ()  # (doc_key, block, number): the dense number of 2^20 chunks of a document
    terms: tuple[str, ...] = ()  # (token, df): changes of document frequencies
    next_id: int = 0
    n_passages: int = 0
    n_dead: int = 0  # stored rows that are no longer there
    total_length: int = 0  # tokens of all passages
    committed_ms: int = 0

    def segments(self) -> set[str]:
        return {s for kind in KINDS for s in getattr(self, kind)}


def _folder(root: str) -> str:
    return f"{root}/_versions"


def numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in paths.names(spark, _folder(root)) if n.endswith(".json") and not n.startswith(".")]


def read(spark: SparkSession, root: str, number: int) -> Version:
    raw = json.loads(paths.read_text(spark, f"{_folder(root)}/{number:020d}.json"))
    return Version(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def latest(spark: SparkSession, root: str) -> Version:
    """The last version; the empty one if there is none."""
    known = numbers(spark, root)
    return read(spark, root, known[-1]) if known else Version()


def commit(spark: SparkSession, root: str, version: Version) -> Version:
    """Make ``version`` the store's last one, or raise ``VersionTaken``."""
    version = dataclasses.replace(version, committed_ms=int(time.time() * 1000))
    text = json.dumps(dataclasses.asdict(version), indent=1)
    if not paths.create_text(spark, f"{_folder(root)}/{version.number:020d}.json", text):
        raise VersionTaken(f"version {version.number} of {root} is there already")
    return version


def vacuum(spark: SparkSession, root: str, keep_ms: int) -> list[str]:
    """Delete versions that were superseded more than ``keep_ms`` ago, and segments that no version left uses.

    Segments younger than ``keep_ms`` stay: a load may be writing them. Returns what was deleted."""
    now, known = time.time() * 1000, numbers(spark, root)
    since, kept, gone = paths.modified(spark, _folder(root)), [], []
    for number, after in zip(known, [*known[1:], None]):
        if after is None or now - since[f"{after:020d}.json"] < keep_ms:
            kept.append(read(spark, root, number))
        else:
            gone.append(f"_versions/{number:020d}.json")
    used = set().union(*[v.segments() for v in kept])
    for kind in KINDS:
        for name, at in sorted(paths.modified(spark, f"{root}/{kind}").items()):
            if f"{kind}/{name}" not in used and now - at >= keep_ms:
                gone.append(f"{kind}/{name}")
    for path in gone:  # the version files come first, so that no version names a segment that is gone
        paths.delete(spark, f"{root}/{path}")
    return gone
