"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into multiword Shift-And masks; one pass over a canonical URL advances every rule at once.
Many URLs are advanced together, position by position, as NumPy words; long lists of rules go in parts of PASS_WORDS words, the first to win
first, and as many URLs at a time as STATE_BYTES holds, so that memory is bounded by parameters.

The canonical URL is ".host" + SEPARATOR + path, the host's A-Z lower-cased. In a glob `*` stands for any run of symbols but the
separator, `**` for any run at all, `?` for any one symbol but the separator, and SEPARATOR for itself.

Defined results: a null URL, or one without "://", has an empty host and path, which no host rule fits; repeated
rows are judged each on its own; very long URLs are read whole; an empty table gives an empty result. Of the rules that fit, the longest wins,
then the first in the list. Only the key and the URL are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bounded_batches

SEPARATOR = "\x00"
ANY, ANY_BUT_SEPARATOR, ONE = -1, -2, -3

#: The masks are broadcast: at most so many bytes (some 300,000 rules over 100 different characters).
MAX_BYTES = 256 << 20

#: Words of 64 symbols that are advanced together, and bytes of their state for one lot of URLs.
PASS_WORDS, STATE_BYTES = 1 << 12, 16 << 20


@dataclass(frozen=True)
class GlobRule:
    """label: what a result calls it, None for a rule that gives a verdict only."""

    glob: str
    verdict: str
    label: str | None = None


def host_rule(rule: str, verdict: str) -> GlobRule:
    """"example.com/en/7": that host and its subdomains, paths that start with /en/7."""
    host, slash, path = rule.partition("/")
    quoted = "".join(f"[{c}]" if c in "*?[" else c for c in slash + path)
    return GlobRule(f"*.{host.lower()}{SEPARATOR}{quoted}**", verdict, rule)


def symbols(glob: str) -> list[int]:
    """Code points, and negative numbers for wildcards; [c] is c itself."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(ANY)
            i += 2
        elif glob[i] == "*":
            out.append(ANY_BUT_SEPARATOR)
            i += 1
        elif glob[i] == "?":
            out.append(ONE)
            i += 1
        elif glob[i] == "[" and glob[i + 2 : i + 3] == "]":
            out.append(ord(glob[i + 1]))
            i += 3
        else:
            out.append(ord(glob[i]))
            i += 1
    return out


def bits_of(parsed: list[int]) -> int:
    return 1 + sum(s not in (ANY, ANY_BUT_SEPARATOR) for s in parsed)


class Automaton:
    """Bit s of a rule is set when its first s symbols have been read; a wildcard keeps the bit below it alive."""

    def __init__(self, rules: list[GlobRule]):
        self.rules = rules
        parsed = [symbols(r.glob) for r in rules]
        literal = sorted({s for p in parsed for s in p if s >= 0})
        self.code = {s: i + 1 for i, s in enumerate(literal)}  # 0: any other symbol
        separator = self.code.get(ord(SEPARATOR), -1)
        self.literals = np.array(literal, np.uint32)
        self.words = max(1, sum(map(bits_of, parsed)) // 64 + 1)
        shape = (len(literal) + 1, self.words)
        self.step, self.stay = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        start, final, one, wild, stay = [], [], [], [], {ANY: [], ANY_BUT_SEPARATOR: []}
        at = 0
        for p in parsed:
            start.append(at)
            for s in p:
                if s in stay:
                    stay[s].append(at)
                else:
                    at += 1
                    (wild if s == ONE else one).append((self.code.get(s, 0), at))
            final.append(at)
            at += 1
        self.start, self.final = self._bits(start), np.array(final, np.int64)
        codes, places = (np.array(x, np.int64) for x in zip(*one, strict=True)) if one else (np.zeros(0, np.int64),) * 2
        np.bitwise_or.at(self.step, (codes, places // 64), np.uint64(1) << (places % 64).astype(np.uint64))
        self.stay |= self._bits(stay[ANY])
        but = np.arange(shape[0]) != separator
        self.stay[but] |= self._bits(stay[ANY_BUT_SEPARATOR])
        self.step[but] |= self._bits([at for _, at in wild])

    def _bits(self, places: list[int]) -> np.ndarray:
        out, at = np.zeros(self.words, np.uint64), np.array(places, np.int64)
        np.bitwise_or.at(out, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        return out

    def run(self, urls: list[str]) -> np.ndarray:
        """A row of booleans, one per rule, for each canonical URL."""
        n = len(urls)
        lengths = np.fromiter(map(len, urls), np.int64, n)
        cp = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.zeros(len(cp), np.int64)
        if len(self.literals):
            at = np.minimum(np.searchsorted(self.literals, cp), len(self.literals) - 1)
            codes = np.where(self.literals[at] == cp, at + 1, 0)
        order = np.argsort(-lengths, kind="stable")  # the URLs still being read are always the first rows
        first, sorted_lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
        state = np.repeat(self.start[None, :], n, axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-sorted_lengths, -t, side="left"))
            c, now = codes[first[:live] + t], state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top  # the carry from word to word
            state[:live] = (moved & self.step[c]) | (now & self.stay[c])
        word, bit = self.final // 64, (self.final % 64).astype(np.uint64)
        out = np.empty((n, len(self.rules)), bool)
        out[order] = (state[:, word] >> bit & one).astype(bool)
        return out


def automata(rules: list[GlobRule]) -> list[Automaton]:
    """The rules in parts of about PASS_WORDS words, in their order."""
    parts, words = [[]], 0.0
    for r in rules:
        words += bits_of(symbols(r.glob)) / 64
        if words > PASS_WORDS and parts[-1]:
            parts.append([])
            words = bits_of(symbols(r.glob)) / 64
        parts[-1].append(r)
    out = [Automaton(p) for p in parts if p]
    if sum(a.step.nbytes + a.stay.nbytes for a in out) > MAX_BYTES:
        raise ValueError(f"the masks of {len(rules)} rules exceed {MAX_BYTES} bytes")
    return out


def first_fit(machines: list[Automaton], urls: list[str]) -> np.ndarray:
    """For each canonical URL the number of the first rule that fits, or the number of all rules."""
    best = np.full(len(urls), sum(len(m.rules) for m in machines), np.int64)
    left, before = np.arange(len(urls)), 0
    for m in machines:
        lot = max(1, STATE_BYTES // (8 * m.words))
        for at in range(0, len(left), lot):
            rows = left[at : at + lot]
            hit = m.run([urls[k] for k in rows])
            best[rows] = np.where(hit.any(axis=1), before + hit.argmax(axis=1), best[rows])
        before += len(m.rules)
        left = left[best[left] >= before]
    return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[GlobRule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule (the label of the longest labelled rule that fits) and verdict for each row.

    A labelled rule goes before a rule without a label. Reads the two columns only; no shuffle.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    parts = pages.select(F.col(f"`{key}`").alias(key), host.alias("host"), path.alias("path"))
    ordered = sorted(rules, key=lambda r: (r.label is None, -len(r.label or r.glob)))
    labels, verdicts = [r.label for r in ordered] + [None], [r.verdict for r in ordered] + [default]
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((automata(ordered), pa.array(labels, pa.string()), pa.array(verdicts, pa.string())))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, label, verdict = shared.value
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            best = pa.array(first_fit(machines, [f".{h}{SEPARATOR}{p}" for h, p in zip(hosts, paths, strict=True)]))
            yield pa.RecordBatch.from_arrays([*b.columns, label.take(best), verdict.take(best)], names=[*b.schema.names, "rule", "verdict"])

    kind = parts.schema[key].dataType.simpleString()
    return parts.mapInArrow(judged, f"`{key}` {kind}, host string, path string, rule string, verdict string")


RULES = [
    host_rule("com/en/", "block"),
    host_rule("example.com/en/7", "allow"),
    host_rule("net/de/", "allow"),
    host_rule("example.net/de/8", "block"),
    host_rule("org/es/", "block"),
    GlobRule(f"*.cheap-pills.**{SEPARATOR}**", "block"),
    GlobRule(f"*.casino*{SEPARATOR}**", "block"),
    GlobRule(f"**{SEPARATOR}**/wp-login.php", "block"),
    GlobRule(f"**{SEPARATOR}**.exe", "block"),
]


def op5_url_automaton(spark, sf_dir: str) -> DataFrame:
    from .text import read_table

    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


OP5_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
f AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) AS k
      FROM p JOIN r ON ends_with('.' || host, '.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN contains('.' || p.host, '.cheap-pills.') OR contains('.' || p.host, '.casino')
       OR ends_with(p.path, '/wp-login.php') OR ends_with(p.path, '.exe') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (page_id)
"""
