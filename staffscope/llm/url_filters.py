"""URL filters as one bit-parallel automaton.

Rules become globs over the canonical url (a dot, the host in lower case, the path): `*` is any run without a slash,
`**` any run. All globs are packed side by side into 64-bit words as Shift-And masks; one pass over the bytes of a url
advances every rule at once: `next = (state << 1) & match[byte] | state & stay[byte]`, with the carry between words.
Urls of a batch advance together as a matrix. The longest rule whose final bit is set decides.

Scale: no shuffle; the masks (256 x words of 8 bytes, a few KB per hundred rules) go out with the task. Work is bytes of
urls times words, memory one state row per url of a batch.

Cases: a null url, or one without `://`, has empty host and path, fits no rule and gets the default; so does an empty
host or path that no rule fits. Very long urls only take more steps. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLASH = ord("/")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


#: (verdict, host, path), as the query states them.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


class Automaton:
    """Globs side by side in 64-bit words. Bit `first[g]` means nothing of glob g is read yet, bit `final[g]` all of it."""

    def __init__(self, globs: Sequence[str]):
        plan, at = [], 0
        self.final = []
        for glob in globs:
            literals, loops = _parse(glob.encode())
            plan.append((at, literals, loops))
            self.final.append(at + len(literals))
            at += len(literals) + 1
        self.words = max(1, -(-at // 64))
        self.match = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for first, literals, loops in plan:
            self._set(self.start, first)
            for offset, byte in enumerate(literals, 1):
                self._set(self.match[byte], first + offset)
            for offset, everything in loops.items():
                for byte in range(256):
                    if everything or byte != SLASH:
                        self._set(self.stay[byte], first + offset)

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << bit % 64)

    def fits(self, texts: pa.Array) -> np.ndarray:
        """A row per text, a column per glob: does it match as a whole?"""
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        lengths = np.diff(ends)
        order = np.argsort(-lengths, kind="stable")  # the texts still being read are always the first ones
        begins, lengths = ends[:-1][order], lengths[order]
        state = np.tile(self.start, (len(order), 1))
        one, top = np.uint64(1), np.uint64(63)
        reading = len(order)
        for step in range(int(lengths[0]) if len(order) else 0):
            while reading and lengths[reading - 1] <= step:
                reading -= 1
            byte = data[begins[:reading] + step]
            now = state[:reading]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:reading] = (moved & self.match[byte]) | (now & self.stay[byte])
        fits = np.empty((len(order), len(self.final)), bool)
        for glob, bit in enumerate(self.final):
            fits[order, glob] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return fits


def _parse(glob: bytes) -> tuple[bytes, dict[int, bool]]:
    """The literal bytes, and after how many of them a run may stand: True for any run, False for one without a slash."""
    literals, loops, at = bytearray(), {}, 0
    while at < len(glob):
        if glob[at:at + 2] == b"**":
            loops[len(literals)] = True
            at += 2
        elif glob[at:at + 1] == b"*":
            loops.setdefault(len(literals), False)
            at += 1
        else:
            literals.append(glob[at])
            at += 1
    return bytes(literals), loops


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path: after the first `://` up to `/`, `?`, `#` or the end; then up to `?` or `#`."""
    url = F.coalesce(url, F.lit(""))
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row. `default` is the verdict where no rule fits; of the rules that
    fit the longest wins, of equally long ones the first stated."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    return parts.mapInArrow(_judge(tuple(rules), default),
                            f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, "
                            "rule string, verdict string")


def _judge(rules: tuple[Rule, ...], default: str):
    ranked = sorted(rules, key=lambda rule: -len(rule.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([rule.glob for rule in ranked])
        names = pa.array([rule.name for rule in ranked], pa.string())
        verdicts = pa.array([rule.verdict for rule in ranked] + [default], pa.string())
        for batch in batches:
            hosts, paths = batch.column("host"), batch.column("path")
            fits = automaton.fits(pa.array([f".{host}{path}" for host, path in zip(hosts.to_pylist(), paths.to_pylist())], pa.string()))
            any_fits = fits.any(axis=1)
            first = np.where(any_fits, fits.argmax(axis=1), len(ranked)) if ranked else np.zeros(len(fits), int)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), hosts, paths, names.take(pa.array(first, pa.int64(), mask=~any_fits)),
                 verdicts.take(pa.array(first, pa.int64()))], ["page_id", "host", "path", "rule", "verdict"])
    return run
