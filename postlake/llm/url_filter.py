"""URL rules as one bit-parallel automaton: all rules and globs are simulated at once over each canonical URL.

The canonical form is a dot, the lower-case host, and the path; the first slash ends the host. A pattern is a run of
positions, each with the bytes it takes; a position may also loop on bytes (a star). Positions of all patterns are bits of
64-bit words, side by side, and a pattern may straddle words. A step is Shift-And: every live position hands its bit to the next one
if that takes the byte, and keeps it if it loops on the byte. A bit of an end position after the last byte is a match. Steps
run over a batch of URLs as arrays, so the cost is bytes times words, however many patterns match.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Positions of all patterns together: the masks go with every task, so their size has a bound (32 MB at 256 kinds of bytes).
MOST_POSITIONS = 1 << 19
#: Bytes of live bits that a batch may take; larger batches go in slices.
STATE_BYTES = 4 << 20

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: What is blocked where no rule fits: globs over the canonical form. * stays in the host or between two slashes, ** goes on, ? is one character.
BLOCKED = (
    "*.ad.*/**", "*.ads.*/**", "*.ads-*/**", "*-ads.*/**", "*.adserver*/**", "*.doubleclick.*/**", "*.track.*/**", "*-track.*/**", "*tracker*/**", "*.click.*/**",
    "*pills*/**", "*viagra*/**", "*casino*/**", "*poker*/**", "*jackpot*/**", "*.xxx/**", "*porn*/**", "*warez*/**",
    "**/wp-login*", "**/cgi-bin/**", "**.exe", "**.zip", "**.iso", "**.apk",
)

_ANY = np.ones(256, dtype=bool)
_SEGMENT = _ANY.copy()
_SEGMENT[ord("/")] = False
_CONTINUED = np.zeros(256, dtype=bool)
_CONTINUED[0x80:0xC0] = True  # bytes that go on a character in UTF-8


def _literal(text: str) -> list[tuple[str, np.ndarray]]:
    return [("take", np.arange(256) == b) for b in text.encode("utf-8", "surrogatepass")]


def rule_pattern(host: str, path: str) -> list[tuple[str, np.ndarray]]:
    """The host, after any labels, and whatever follows the path. An empty host is that of URLs without one."""
    return [("loop", _SEGMENT), *_literal(f".{host}{path}"), ("loop", _ANY)]


def glob_pattern(glob: str) -> list[tuple[str, np.ndarray]]:
    out, k = [], 0
    while k < len(glob):
        if glob.startswith("**", k):
            out.append(("loop", _ANY))
            k += 2
        else:
            out += [("loop", _SEGMENT)] if glob[k] == "*" else [("take", _SEGMENT & ~_CONTINUED), ("loop", _CONTINUED)] if glob[k] == "?" else _literal(glob[k])
            k += 1
    return out


@dataclass
class Automaton:
    """Patterns packed into masks. ``kind`` gives a byte's row of ``take`` and ``loop``, as most bytes are alike to all patterns."""

    kind: np.ndarray
    take: np.ndarray
    loop: np.ndarray
    first: np.ndarray
    last: list[int]

    @classmethod
    def of(cls, patterns: list[list[tuple[str, np.ndarray]]]) -> Automaton:
        sizes = [1 + sum(what == "take" for what, _ in p) for p in patterns]
        bits = sum(sizes)
        if bits > MOST_POSITIONS:
            raise ValueError(f"the patterns have {bits} positions; {MOST_POSITIONS} at most go into one automaton")
        words = bits // 64 + 1
        take, loop = np.zeros((256, words * 64), dtype=bool), np.zeros((256, words * 64), dtype=bool)
        first, last, at = np.zeros(words * 64, dtype=bool), [], 0
        for p, size in zip(patterns, sizes):
            first[at], here = True, at
            for what, taken in p:
                if what == "take":
                    here += 1
                    take[:, here] = taken
                else:
                    loop[:, here] |= taken
            last.append(here)
            at += size
        rows, kind = np.unique(np.concatenate([take, loop], axis=1), axis=0, return_inverse=True)
        packed = np.packbits(rows, axis=1, bitorder="little").view(np.uint64)
        return cls(kind.ravel(), packed[:, :words].copy(), packed[:, words:].copy(), np.packbits(first, bitorder="little").view(np.uint64), last)

    @cached_property
    def rows_at_once(self) -> int:
        return max(1, STATE_BYTES // (8 * len(self.first)))

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Booleans (text, pattern)."""
        out = np.zeros((len(texts), len(self.last)), dtype=bool)
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))  # long ones first: those not at their end are always the first rows
        for start in range(0, len(order), self.rows_at_once):
            part = order[start : start + self.rows_at_once]
            lengths = np.array([len(texts[k]) for k in part])
            codes = self.kind[np.frombuffer(b"".join(texts[k] for k in part), dtype=np.uint8)]
            offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            live = np.tile(self.first, (len(part), 1))
            n = len(part)
            for t in range(lengths[0] if n else 0):
                while lengths[n - 1] <= t:
                    n -= 1
                c = codes[offsets[:n] + t]
                now = live[:n]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                live[:n] = (moved & self.take[c]) | (now & self.loop[c])
            for k, bit in enumerate(self.last):
                out[part, k] = (live[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) > 0
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def judged(host: Column, path: Column, rules: tuple = RULES, blocked: tuple = BLOCKED) -> Column:
    """A struct of rule and verdict. Of rules of equal length that fit, one that blocks wins, then the first by bytes."""
    ranked = sorted(dict.fromkeys(rules), key=lambda r: (-len(f"{r[1]}{r[2]}"), r[0] == "allow", f"{r[1]}{r[2]}".encode()))
    automaton = Automaton.of([rule_pattern(r[1], r[2]) for r in ranked] + [glob_pattern(g) for g in blocked])
    names, verdicts = np.array([*(f"{r[1]}{r[2]}" for r in ranked), None], dtype=object), np.array([r[0] for r in ranked], dtype=object)

    @F.pandas_udf("rule string, verdict string")
    def judge(canonical: pd.Series) -> pd.DataFrame:
        found = automaton.matches([x.encode("utf-8", "surrogatepass") for x in canonical])
        ruled, blocks = found[:, : len(ranked)], found[:, len(ranked) :].any(axis=1)
        best = np.where(ruled.any(axis=1), ruled.argmax(axis=1) if len(ranked) else 0, len(ranked))
        other = np.where(blocks, "block", "allow").astype(object)
        verdict = np.where(best < len(ranked), np.concatenate([verdicts, [None]])[best], other)
        return pd.DataFrame({"rule": names[best], "verdict": verdict})

    return judge(F.concat(F.lit("."), host, path))


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple = RULES, blocked: tuple = BLOCKED) -> DataFrame:
    """``pages`` with host, path, rule and verdict of each row's ``url``; columns of these names are replaced, others stay.

    A null URL or one without ``://`` has an empty host and path, fits no rule, and is allowed. URLs are taken whole, however long.
    Repeated rows get equal verdicts, an empty table gives none. Where no rule fits, a glob of ``blocked`` blocks and nothing else does.
    Nothing is shuffled; the masks (``MOST_POSITIONS``) go with the tasks.
    """
    source = F.col(url)
    pages = pages.withColumns({"_host": host_of(source), "_path": path_of(source)})
    out = pages.withColumn("_judged", judged(F.col("_host"), F.col("_path"), rules, blocked))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "_host", "_path")]
    return out.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_judged.rule").alias("rule"), F.col("_judged.verdict").alias("verdict"))
