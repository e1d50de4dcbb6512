"""URL filters by a bit-parallel wildcard automaton.

Glob rules over canonical URLs are packed into 64-bit words, one bit a pattern
position.  A Shift-And step for each character advances all patterns on all
URLs of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In canonical form between host and path; not a byte of UTF-8 text.
SEPARATOR = 0xFF


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``.

    In both, ``*`` stands for any run of characters of that part and ``?`` for
    one byte.
    """

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query; fixed values.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


class Automaton:
    """The rules' masks.

    A canonical URL is ``.host`` SEPARATOR ``path``.  A rule's pattern is the
    same form and may start anywhere, so that its first dot is a domain
    boundary and its separator the end of the host.
    """

    def __init__(self, rules: Sequence[Rule]):
        symbols: list[tuple[int, int | None, bool]] = []  # rule, byte or None for any, loops before it
        self.last = []
        for number, rule in enumerate(rules):
            loop = False
            for byte in b"." + rule.host.lower().encode() + bytes([SEPARATOR]) + rule.path.encode():
                if byte == ord("*"):
                    loop = True
                else:
                    symbols.append((number, None if byte == ord("?") else byte, loop))
                    loop = False
            self.last.append(len(symbols) - 1)
        words = max(1, -(-len(symbols) // 64))
        self.masks = np.zeros((256, words), dtype=np.uint64)
        self.first = np.zeros(words, dtype=np.uint64)
        self.stay = np.zeros(words, dtype=np.uint64)
        before = None
        for at, (number, byte, loop) in enumerate(symbols):
            bit = np.uint64(1 << (at % 64))
            if byte is None:
                self.masks[:SEPARATOR, at // 64] |= bit
            else:
                self.masks[byte, at // 64] |= bit
            if number != before:
                self.first[at // 64] |= bit
            elif loop:  # the state before it waits
                self.stay[(at - 1) // 64] |= np.uint64(1 << ((at - 1) % 64))
            before = number
        self.verdicts = [r.verdict for r in rules]
        self.names = [r.name for r in rules]
        self.rank = np.argsort(np.argsort([-len(r.name) for r in rules], kind="stable"), kind="stable")

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """(URL, rule) booleans; all URLs and patterns advance together."""
        found = np.zeros((len(urls), len(self.last)), dtype=bool)
        if not urls:
            return found
        lengths = np.array([len(u) for u in urls])
        order = np.argsort(-lengths, kind="stable")
        table = np.zeros((int(lengths.max()), len(urls)), dtype=np.uint8)
        for column, k in enumerate(order):
            table[: lengths[k], column] = np.frombuffer(urls[k], dtype=np.uint8)
        active = np.searchsorted(-lengths[order], -np.arange(len(table)), side="left")
        state = np.zeros((len(urls), len(self.first)), dtype=np.uint64)
        ever = np.zeros_like(state)
        one, top = np.uint64(1), np.uint64(63)
        for row, n in zip(table, active, strict=True):
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top  # patterns run on into the next word
            waits = now & self.stay
            waits[row[:n] == SEPARATOR] = 0  # a wildcard stays within its part
            state[:n] = ((moved | self.first) & self.masks[row[:n]]) | waits
            ever[:n] |= state[:n]
        for rule, at in enumerate(self.last):
            found[order, rule] = (ever[:, at // 64] >> np.uint64(at % 64)) & one == 1
        return found


def _judge(automaton, default: str, run_bytes: int = 1 << 22):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            urls = [b"." + h.encode() + bytes([SEPARATOR]) + p.encode() for h, p in zip(hosts, paths, strict=True)]
            rules, verdicts = [None] * len(urls), [default] * len(urls)
            order = sorted(range(len(urls)), key=lambda k: len(urls[k]))
            at = 0
            while at < len(order):  # URLs of like length, in tables of bounded size
                stop = at + 1
                while stop < len(order) and len(urls[order[stop]]) * (stop - at + 1) <= run_bytes:
                    stop += 1
                group = order[at:stop]
                hit = own.matches([urls[k] for k in group])
                for k, row in zip(group, hit, strict=True):
                    fits = np.flatnonzero(row)
                    if len(fits):
                        best = fits[np.argmin(own.rank[fits])]
                        rules[k], verdicts[k] = own.names[best], own.verdicts[best]
                at = stop
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: host, path, the longest rule that fits, and the verdict.

    A null URL or one without ``://`` has an empty host and path.  No rule
    fitting, the rule is null and the verdict ``default``.  Of rules of one
    length the first in the list wins.  The rules are broadcast.
    """
    automaton = pages.sparkSession.sparkContext.broadcast(Automaton(rules))
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    judged = parts.mapInArrow(_judge(automaton, default), "page_id long, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("page_id", id_col)
