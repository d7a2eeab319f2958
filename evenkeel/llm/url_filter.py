"""URL rules in a sorted array of 64-bit digests.

``build_index`` lays a list of rules (host, path, verdict) out as one sorted array of xxhash64 keys with
the stored strings beside it. Each Python worker writes the array to a file of its own once, memory-maps
it and probes it by binary search over whole batches: every suffix of the url's host joined with every
prefix of its path that has the length of some rule's path. A hit counts only if the stored string is
the probed one, so equal digests of different strings do no harm.

The list travels to the workers as one broadcast and may hold ``MAX_LIST_BYTES``; a longer list is
refused. Null urls, and those without ``://``, have an empty host and path, fit no rule and get the
default verdict. Repeated rows are judged alike; an empty table gives an empty one; other columns pass
through, and columns named like the results are replaced.
"""

from __future__ import annotations

import os
import tempfile
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import ascii_lower

MAX_LIST_BYTES = 256 << 20


class RuleIndex(NamedTuple):
    digests: bytes  # sorted little-endian uint64
    keys: list[str]  # host and path, in the order of the digests
    verdicts: list[str]
    path_lengths: list[int]  # in bytes


def build_index(rules: list[tuple[str, str, str]]) -> RuleIndex:
    """Rules (host, path, verdict) sorted by digest; of rules repeated for one key the last counts."""
    latest = {host.lower() + path: (path, verdict) for host, path, verdict in rules}
    order = sorted((xxhash.xxh64_intdigest(key), key) for key in latest)
    index = RuleIndex(np.array([d for d, _ in order], dtype="<u8").tobytes(), [key for _, key in order],
                      [latest[key][1] for _, key in order], sorted({len(path.encode()) for path, _ in latest.values()}))
    size = len(index.digests) + sum(len(key.encode()) for key in index.keys)
    if size > MAX_LIST_BYTES:
        raise ValueError(f"the rules take {size} bytes; {MAX_LIST_BYTES} are allowed")
    return index


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_mapped: dict[int, np.ndarray] = {}


def _map_digests(index: RuleIndex) -> np.ndarray:
    """The digests, memory-mapped from a file that is unlinked as soon as it is open."""
    name = hash(index.digests)
    if name not in _mapped:
        if not index.keys:
            _mapped[name] = np.empty(0, dtype="<u8")
        else:
            handle, path = tempfile.mkstemp()
            with os.fdopen(handle, "wb") as out:
                out.write(index.digests)
            _mapped[name] = np.memmap(path, dtype="<u8", mode="r")
            os.unlink(path)
    return _mapped[name]


def probes(host: str, path: str, path_lengths: list[int]) -> list[str]:
    """All rule keys that would fit: host suffixes at label borders with prefixes of the path."""
    labels = host.split(".")
    raw = path.encode()
    prefixes = [raw[:n].decode(errors="surrogateescape") for n in path_lengths if n <= len(raw)]
    return [".".join(labels[i:]) + prefix for i in range(len(labels)) for prefix in prefixes]


def match(hosts: list[str], paths: list[str], index: RuleIndex) -> list[int]:
    """For each url the place of its longest rule in the index, or -1."""
    digests = _map_digests(index)
    probed, rows = [], []
    for row, (host, path) in enumerate(zip(hosts, paths)):
        if host:
            found = probes(host, path, index.path_lengths)
            probed += found
            rows += [row] * len(found)
    best = [-1] * len(hosts)
    wanted = np.fromiter((xxhash.xxh64_intdigest(p.encode(errors="surrogateescape")) for p in probed), dtype="<u8", count=len(probed))
    low, high = np.searchsorted(digests, wanted, "left"), np.searchsorted(digests, wanted, "right")
    for i in np.flatnonzero(high > low):
        for place in range(low[i], high[i]):
            key, row = index.keys[place], rows[i]
            if key == probed[i] and (best[row] < 0 or len(key) > len(index.keys[best[row]])):
                best[row] = place
    return best


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``; the longest rule wins."""
    shipped = pages.sparkSession.sparkContext.broadcast(build_index(rules))
    results = ("host", "path", "rule", "verdict")
    rest = [F.col(c) for c in pages.columns if c not in results]
    parts = pages.select(*rest, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            places = match(batch.column("host").to_pylist(), batch.column("path").to_pylist(), index)
            rule = pa.array([index.keys[p] if p >= 0 else None for p in places], pa.string())
            verdict = pa.array([index.verdicts[p] if p >= 0 else default for p in places], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    schema = parts.withColumns({"rule": F.lit("").cast("string"), "verdict": F.lit("").cast("string")}).schema
    for field in schema.fields:
        field.nullable = True
    return parts.mapInArrow(judge, schema)
