"""Language identification by fusing evidence the Bayesian way.

A page's language has a prior from its host, smoothed towards its domain's and the whole corpus's (each level backs off to the next
with STRENGTH pseudo-pages), and three pieces of evidence: the text's likelihood under letter models of each language,
the language its markup declares, and its address suffix. How often pages of a language declare what, or lie under which suffix,
is counted with the text's posterior as a soft label, by grouped aggregations; a page's own share is taken out of every count that
judges it.

The languages are those of the labelled texts that the letter models are fitted on.

Defined results: a page without text is judged by its other evidence; without any evidence at all, by the corpus prior; a null html declares
nothing; a null url has an empty host, domain and suffix, which count as values of their own; rows that repeat are judged alike; of equally
probable languages the first by name wins; very long and malformed pages are read whole, in one pass; without labelled texts lang is null; an empty
table gives an empty result. Of a page only the key, url and html are read, whatever its other columns are called.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .letters import Table, below, grams, typed
from .text import bounded_batches, written
from .tokens import U
from .url_automaton import host_and_path

#: Distinct labelled texts of each language for the letter models, the first ones by hash.
SAMPLE = 8_000
STRENGTH = 4.0

#: Letters whose evidence counts in full; neighbours are not independent, so that of longer texts is scaled down to so many.
MOST_LETTERS = 150

_OPEN = re.compile(r"(?ia)<(?:(script|style|noscript|template)\b|(!--))?")
_CLOSE = {name: re.compile(rf"(?ia)</{name}\s*>") for name in ("script", "style", "noscript", "template")} | {"!--": re.compile("-->"), "": re.compile(">")}
_HTML = re.compile(r"(?ia)<html\b")
_LANG = re.compile(r"""(?ia)\slang\s*=\s*(?:["']\s*)?([a-z]{2,3})\b""")


def visible(page: str | None) -> str:
    """The text of a page without tags, comments and what isn't shown. One pass: what has no end is looked for once."""
    if not page:
        return ""
    out, start, at, endless = [], 0, 0, set()
    while "" not in endless and (m := _OPEN.search(page, at)):
        for name in (*([(m[1] or m[2]).lower()] if m[1] or m[2] else []), ""):
            if name not in endless:
                end = _CLOSE[name].search(page, m.end() if name else m.start())
                if end:
                    out.append(page[start : m.start()])
                    start = at = end.end()
                    break
                endless.add(name)
        else:
            at = m.end()
    return markup.unescape(" ".join([*out, page[start:]]))


def declared(page: str | None) -> str:
    """The language that the first html tag with a lang attribute names; each tag is read once."""
    at = 0
    while page and (m := _HTML.search(page, at)):
        at = page.find(">", m.end())
        at = len(page) if at < 0 else at
        if found := _LANG.search(page, m.end(), at):
            return found[1].lower()
    return ""


class Letters:
    """log P(last byte | two bytes before it) per language, for byte trigrams inside words."""

    def __init__(self, languages: list[str], keys: np.ndarray, counts: np.ndarray):
        """counts: keys x languages."""
        self.languages = languages
        context, which = np.unique(keys >> U(8), return_inverse=True)
        total = np.zeros((len(context), len(languages)))
        np.add.at(total, which, counts)
        letter = np.zeros((256, len(languages)))
        np.add.at(letter, (keys & U(255)).astype(np.int64), counts)
        base = (letter + 0.5) / (letter.sum(axis=0) + 128)
        p = (counts + 4 * base[(keys & U(255)).astype(np.int64)]) / (total[which] + 4)
        self.table, self.log = Table(keys, np.arange(1, len(keys) + 1)), np.vstack([np.zeros(len(languages)), np.log(p)])

    def likelihoods(self, texts: pa.Array) -> np.ndarray:
        """Scaled log-likelihoods, a row per text; zeros where no letter is known."""
        out = np.zeros((len(texts), len(self.languages)))
        for at, _, offsets, which, letters, o in typed(texts):
            if not len(which):
                continue
            key, _, kind = grams(letters, o)
            place, _ = self.table.get(below(key, 3))
            row = self.log[place.astype(np.int64)]
            known = np.bincount(kind, place > 0, len(o) - 1)
            by_type = np.stack([np.bincount(kind, c, len(o) - 1) for c in row.T], axis=1)
            ends = offsets
            total = np.concatenate([np.zeros((1, row.shape[1])), np.cumsum(by_type[which], axis=0)])
            n = np.concatenate([[0.0], np.cumsum(known[which])])
            length = np.diff(n[ends])
            out[at : at + len(ends) - 1] = np.diff(total[ends], axis=0) * (np.minimum(length, MOST_LETTERS) / np.maximum(length, 1))[:, None]
        return out


def picked(texts: DataFrame, text: str, lang: str, sample: int) -> DataFrame:
    """text, lang: the `sample` distinct texts with the lowest hashes of every language, or all it has.

    A language's number of distinct hashes gives the part of their range that holds its sample and little more; only what
    lies there is grouped with its text and ranked, so that no task sees a language whole.
    """
    rows = texts.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.lower(F.col(lang)).alias("lang"))
    rows = rows.withColumn("r", F.xxhash64("text", "lang"))
    sizes = rows.select("lang", "r").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    part = F.lit(sample + 8 * sample**0.5 + 16) / F.col("n")
    cuts = written(sizes.select(F.col("lang").alias("_lang"), F.when(part >= 1, F.lit((1 << 63) - 1)).otherwise((part * 2.0**64 - 2.0**63).cast("long")).alias("cut")), "language-cuts")
    low = rows.join(cuts, (F.col("lang") == F.col("_lang")) & (F.col("r") <= F.col("cut"))).groupBy("lang", "r").agg(F.min("text").alias("text"))
    return low.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("r"))).filter(F.col("_k") <= sample).select("text", "lang")


def fit(texts: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Letters:
    """Letter models of all labelled languages, each from up to `sample` of its distinct texts."""
    bounded_batches(texts.sparkSession)
    few = written(picked(texts, text, lang, sample), "language-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang_of = batch.column("lang")
            for name in lang_of.unique().to_pylist():
                for _, _, _, which, letters, o in typed(batch.filter(pa.compute.equal(lang_of, name)).column("text")):
                    if len(which):
                        key, _, kind = grams(letters, o)
                        unique, inverse = np.unique(below(key, 3), return_inverse=True)
                        n = np.bincount(inverse, np.bincount(which, minlength=len(o) - 1)[kind]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(unique)), pa.array(unique.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])

    counts = few.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    keys, at = np.unique(counts["key"].to_numpy().astype(np.int64).view(U), return_inverse=True)
    table = np.zeros((len(keys), len(languages)))
    table[at, counts["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(dtype=np.int64)] = counts["n"].to_numpy()
    return Letters(languages, keys, table)


def evidence(pages: DataFrame, model: Letters, key: str = "page_id") -> DataFrame:
    """key, host, domain, suffix, declared, ll (scaled log-likelihoods in the order of the model's languages), t (what the text alone makes of them)."""
    bounded_batches(pages.sparkSession)
    host, _ = host_and_path(F.col("url"))
    labels = F.split(host, r"\.")
    domain = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column("html").to_pylist()
            ll = shared.value.likelihoods(pa.array(map(visible, source), pa.string()))
            k = ll.shape[1]
            lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, k, dtype=np.int32), pa.array(x.ravel())) for x in (ll, softmax(ll))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "host", "domain", "suffix")], pa.array(map(declared, source), pa.string()), *lists], names=["key", "host", "domain", "suffix", "declared", "ll", "t"])

    rows = pages.select(F.col(f"`{key}`").alias("key"), host.alias("host"), domain.alias("domain"), F.element_at(labels, -1).alias("suffix"), "html")
    return rows.mapInArrow(run, f"key {pages.schema[key].dataType.simpleString()}, host string, domain string, suffix string, declared string, ll array<double>, t array<double>")


def softmax(logs: np.ndarray) -> np.ndarray:
    """Rows of logarithms as shares of 1."""
    each = np.exp(logs - logs.max(axis=1, keepdims=True))
    return each / each.sum(axis=1, keepdims=True)


def fused(ll: np.ndarray, t: np.ndarray, by: dict[str, np.ndarray], spoken: np.ndarray, everything: dict, strength: float) -> np.ndarray:
    """The posterior of each page: its text, the priors of its host within its domain within all pages, its suffix and its declared language.
    by: sums of t over the pages of its host h, domain d, suffix s and declaration a, of which its own share is taken off."""
    own = {tag: np.maximum(x - t, 0) for tag, x in {**by, "g": np.array(everything["g"])[None]}.items()}
    k = ll.shape[1]
    prior = (own["g"] + 1) / (own["g"].sum(axis=1, keepdims=True) + k)
    for tag in ("d", "h"):
        prior = (own[tag] + strength * prior) / (own[tag].sum(axis=1, keepdims=True) + strength)
    given = lambda tag, kinds: np.log((own[tag] + 0.5) / (own["g"] + 0.5 * (kinds + 1)))
    return softmax(ll + np.log(prior) + given("s", everything["suffixes"]) + np.where(spoken[:, None], given("a", everything["declarations"]), 0.0))


def identify(pages: DataFrame, model: Letters, key: str = "page_id", strength: float = STRENGTH) -> DataFrame:
    """key, lang (the most probable, of equal ones the first by name), probability, text_lang (by text alone), declared, posterior (map).

    Sums by host, domain, suffix and declaration are grouped aggregations of one array of columns each; what a page makes of them is worked
    out on arrays, so that plans grow with the number of languages and no faster."""
    languages, k = model.languages, len(model.languages)
    kind = pages.schema[key].dataType.simpleString()
    if not k:
        return pages.select(F.col(f"`{key}`").alias(key), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("map<string,double>").alias("posterior"))
    flat = written(evidence(pages, model, key), "language-evidence")
    total = lambda column: F.array(*[F.sum(F.col(column)[i]) for i in range(k)])
    # the smallest table for every level: each level is summed from the one below
    cells = written(flat.groupBy("host", "domain", "suffix", "declared").agg(total("t").alias("c")), "language-cells")
    up = lambda by, tag: cells.groupBy(by).agg(total("c").alias(tag))
    everything = cells.agg(total("c").alias("g"), F.count_distinct("suffix").alias("suffixes"), F.count_distinct("declared").alias("declarations")).first().asDict()
    everything["g"] = [x or 0.0 for x in everything["g"]]
    level = flat.join(up("host", "h"), "host").join(up("domain", "d"), "domain").join(up("suffix", "s"), "suffix").join(up("declared", "a"), "declared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: np.asarray(batch.column(c).flatten(), np.float64).reshape(-1, k) for c in ("ll", "t", "h", "d", "s", "a")}
            spoken = pc.not_equal(batch.column("declared"), "").to_numpy(zero_copy_only=False)
            post = fused(x["ll"], x["t"], {c: x[c] for c in "hdsa"}, spoken, everything, strength)
            best, by_text = post.argmax(axis=1), x["t"].argmax(axis=1)
            name = pa.array(languages, pa.string())
            maps = pa.MapArray.from_arrays(np.arange(0, post.size + 1, k, dtype=np.int32), name.take(pa.array(np.tile(np.arange(k), len(post)))), pa.array(post.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), name.take(pa.array(best)), pa.array(post[np.arange(len(post)), best]), name.take(pa.array(by_text)), batch.column("declared"), maps], names=["key", "lang", "probability", "text_lang", "declared", "posterior"])

    scored = level.select("key", "declared", "ll", "t", "h", "d", "s", "a").mapInArrow(run, f"key {kind}, lang string, probability double, text_lang string, declared string, posterior map<string,double>")
    return scored.select(F.col("key").alias(key), "lang", "probability", "text_lang", F.when(F.col("declared") != "", F.col("declared")).alias("declared"), "posterior")


def op2_language(spark, sf_dir: str) -> DataFrame:
    """The language of every page."""
    from .text import read_table

    model = fit(read_table(spark, sf_dir, "documents").select("text", "lang"))
    return identify(read_table(spark, sf_dir, "pages"), model).select("page_id", "lang", "probability", "text_lang", "declared")
