"""Repeated passages: words covered by a window of words that starts in a document with a smaller id.

1. Phrases. A phrase is half a window long (25 words of 50). Of the phrases inside a window the one with
   the least hash is its anchor, so equal windows have equal anchors. Phrases that are anchors in two
   documents recur: they are confirmed, and their words are taken from the first document that has them.
2. Automata. The confirmed phrases are sharded by that first document, and each shard is compiled, as
   sequences of word numbers, into an Aho-Corasick automaton. Every document that holds a confirmed phrase
   streams whole through the shards it needs (no other shard has an anchor of its own), which locates every
   occurrence, word for word; what isn't located isn't looked at further. A passage's phrases lie in one
   shard, so a document needs about as many shards as it shares passages with different documents, whatever
   the corpus. A shard that many documents need is compiled in several tasks, which share the documents.
3. Runs. The windows that share one occurrence of an anchor form a run. A run that occurs whole in a
   document with a smaller id is covered. Of the other runs the windows are compared one by one; this is
   exact, since in the first document that holds a window its run occurs in no earlier one.

Runs and windows are compared by two hashes of 64 bits. Nothing is gathered by key beyond what one document
holds, and no join gives a frequent key to one task.

Null, empty and short texts keep all words. A null id neither removes nor loses words. Rows that repeat
an id are judged one by one, each against smaller ids only. Other columns of the input play no part. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_words, column, join_counted, map_rows, rows

#: Odd multipliers of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

#: Ids sent to all executors for a semi-join ahead of the shuffle, at most; beyond it, all texts shuffle.
SEMI_JOIN_IDS = 2_000_000

#: Phrases of an automaton, about (a first document's phrases stay together), and documents of a task that has one.
SHARD_PHRASES, SHARD_DOCS = 10_000, 2_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each run of n words (modulo 2**64, from prefix sums)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    inverse = np.cumprod(np.full(len(h), pow(base, -1, 1 << 64), np.uint64))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * inverse)])
    power = np.cumprod(np.full(len(h) - n + 1, base, np.uint64))
    return mixed((prefix[n:] - prefix[:-n]) * power)


def anchors(phrases: np.ndarray, span: int) -> np.ndarray:
    """For each window, the position of the least phrase hash inside it, leftmost if tied."""
    out = np.empty(len(phrases) - span + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(phrases, span)
    for at in range(0, len(out), 16384):
        out[at : at + 16384] = view[at : at + 16384].argmin(1)
    return out + np.arange(len(out))


class Text:
    """A document's words and the hashes of its phrases and runs."""

    def __init__(self, text: str | bytes | None, window: int):
        self.words, self.window, self.phrase = text.split() if isinstance(text, bytes) else byte_words(text), window, (window + 1) // 2
        self.any = len(self.words) >= window
        if self.any:
            self.h = word_hashes(self.words)
            self.phrases = rolling(self.h, self.phrase, BASES[0])
            at = anchors(self.phrases, window - self.phrase + 1)
            self.first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # of each run, its first window
            self.last = np.concatenate([self.first[1:], [len(at)]]) - 1
            self.at = at[self.first]

    def runs(self, base: int) -> np.ndarray:
        """A hash of the words of each run, from their first to their last."""
        inverse = np.cumprod(np.full(len(self.h), pow(base, -1, 1 << 64), np.uint64))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * inverse)])
        power = np.cumprod(np.full(len(self.h), base, np.uint64))
        length = self.last - self.first + self.window
        return mixed((prefix[self.first + length] - prefix[self.first]) * power[self.first] + length.astype(np.uint64))


def key_of(text: str | None) -> int:
    """Tells apart rows that share an id."""
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def first_phrases(docs: DataFrame, window: int) -> DataFrame:
    """phrase, doc_id: the anchors of each document, once each."""

    def run(batches: Iterator) -> Iterator[dict]:
        for b in batches:
            phrases, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d is not None and (x := Text(t, window)).any:
                    phrases.append(np.unique(x.phrases[x.at]))
                    ids.append(np.full(len(phrases[-1]), d, np.int64))
            yield {"phrase": np.concatenate(phrases).view(np.int64), "doc_id": np.concatenate(ids)}

    return map_rows(docs, run, "phrase long,doc_id long")


def confirmed(work: DataFrame, window: int) -> DataFrame:
    """phrase, words: the text of the phrases that column own lists, from their first document."""

    def run(batches: Iterator) -> Iterator[dict]:
        for text, own in rows(batches, 0, 1):
            x = Text(text, window)
            if x.any:
                hashes, at = np.unique(x.phrases[x.at], return_index=True)
                which = np.isin(hashes.view(np.int64), own)
                yield {"phrase": hashes[which].view(np.int64), "words": [b" ".join(x.words[p : p + x.phrase]) for p in x.at[at[which]].tolist()]}

    return map_rows(work.where("size(own) > 0").select("text", "own"), run, "phrase long,words binary")


class Shard:
    """An automaton over phrases, as sequences of numbers of their words.

    A node's children are searched one by one, and a phrase may begin with any of thousands of words, so a
    number is written as two letters: its high part, above all low parts, and its low part.
    """

    LOW = 128

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.ready = False

    def letters(self, numbers: np.ndarray) -> tuple[int, ...]:
        high, low = np.divmod(numbers, self.LOW)
        return tuple(np.column_stack([high + self.LOW, low]).ravel().tolist())

    def add(self, phrase: bytes) -> None:
        line = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in phrase.split()]
        self.automaton.add_word(self.letters(np.array(line)), len(line))

    def locate(self, words: list[bytes]) -> np.ndarray:
        """Where a phrase of the shard begins; words that no phrase has are number 0."""
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        if not len(self.automaton):
            return np.zeros(0, np.int64)
        line = self.letters(np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words)))
        return np.fromiter((end // 2 - n + 1 for end, n in self.automaton.iter(line)), np.int64)


RUN = ("run", "run2", "length")


def recurring_runs(work: DataFrame, phrases: DataFrame, window: int) -> DataFrame:
    """run, run2, length, doc_id, key, lo, hi: the runs of windows around the phrases that the shards locate.

    work: doc_id, key, text and visits (shard, task); phrases: shard, task, words.
    """
    docs = work.select(F.explode("visits").alias("v"), "doc_id", "key", F.col("text").cast("binary").alias("text"))
    docs = docs.select("v.shard", "v.task", F.lit(1).alias("kind"), "doc_id", "key", "text")
    none = F.lit(None).cast("long")
    both = docs.unionByName(phrases.select("shard", "task", F.lit(0).alias("kind"), none.alias("doc_id"), none.alias("key"), F.col("words").alias("text")))
    both = both.repartition("shard", "task").sortWithinPartitions("shard", "task", "kind")
    names = (*RUN, "doc_id", "key", "lo", "hi")

    def run(batches: Iterator) -> Iterator[dict]:
        at, shard, out = None, Shard(), {k: [] for k in names}
        for s, task, kind, d, k, text in rows(batches, *range(6)):
            if (s, task) != at:
                at, shard = (s, task), Shard()
            if not kind:
                shard.add(text)
                continue
            x = Text(text, window)
            hit = np.isin(x.at, shard.locate(x.words)) if x.any else np.zeros(0, bool)
            if hit.any():
                lo, hi = x.first[hit], x.last[hit]
                one, two = (x.runs(base)[hit].view(np.int64) for base in BASES)
                for name, v in zip(names, (one, two, hi - lo, np.full(len(lo), d), np.full(len(lo), k), lo, hi), strict=True):
                    out[name].append(v)
                if len(out["lo"]) >= 256:
                    yield {k: np.concatenate(v).astype(np.int64) for k, v in out.items()}
                    out = {k: [] for k in names}
        if out["lo"]:
            yield {k: np.concatenate(v).astype(np.int64) for k, v in out.items()}

    return map_rows(both, run, ",".join(f"{n} long" for n in names))


def windows_of(open_: DataFrame, window: int) -> DataFrame:
    """h1, h2, doc_id, key, at: each window of the runs that column runs lists."""

    def run(batches: Iterator) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in ("h1", "h2", "doc_id", "key", "at")}
            for d, k, t, runs in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                h = word_hashes(byte_words(t))
                at = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in runs]))
                one, two = rolling(h, window, BASES[0])[at], rolling(h, window, BASES[1])[at]
                for name, v in (("h1", one.view(np.int64)), ("h2", two.view(np.int64)), ("doc_id", np.full(len(at), d)), ("key", np.full(len(at), k)), ("at", at)):
                    out[name].append(v)
            yield {k: np.concatenate(v) for k, v in out.items()}

    return map_rows(open_.select("doc_id", "key", "text", "runs"), run, "h1 long,h2 long,doc_id long,key long,at int")


def kept(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, key, n_words, n_removed, kept_sha256 (and kept, the text that is left) after removing spans, if docs has them."""

    def run(batches: Iterator) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "key", "n_words", "n_removed", "kept_sha256", "kept")}
            spans = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            for d, t, cut in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), spans, strict=True):
                words = byte_words(t)
                n = len(words)
                if cut:
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, [s["lo"] for s in cut], 1)
                    np.add.at(depth, [s["hi"] for s in cut], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
                for name, v in (("doc_id", d), ("key", key_of(t)), ("n_words", n), ("n_removed", n - len(words)), ("kept_sha256", sha(words))):
                    out[name].append(v)
                out["kept"].append(b" ".join(words).decode("utf-8", "surrogatepass") if texts else None)
            yield out

    return map_rows(docs, run, "doc_id long,key long,n_words long,n_removed long,kept_sha256 string,kept string")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if texts, kept (the words that are left), per row."""
    scratch = Scratch(docs.sparkSession, "passages")
    docs = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))

    phrases = scratch.table(first_phrases(docs, window), "phrases")
    shared = phrases.groupBy("phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    shared = scratch.table(shared.where("first < last").select("phrase", "first", "n"), "shared")
    shards = max(1, -(-shared.count() // SHARD_PHRASES))
    shard = F.pmod(F.xxhash64("first"), F.lit(shards)).alias("shard")
    # which shards a document needs, and which of its phrases it has first
    held = join_counted(phrases, shared, ["phrase"]).select("doc_id", "phrase", shard, (F.col("doc_id") == F.col("first")).alias("is_own"))
    visits = scratch.table(held.groupBy("doc_id", "shard").agg(F.collect_list(F.when(F.col("is_own"), F.col("phrase"))).alias("own")), "visits")
    scratch.drop(phrases)
    tasks = scratch.table(visits.groupBy("shard").agg(F.count("*").alias("n"), F.ceil(F.count("*") / SHARD_DOCS).cast("int").alias("tasks")), "tasks")
    visits = join_counted(visits, tasks, ["shard"])
    visit = F.struct("shard", F.pmod(F.xxhash64("doc_id"), F.col("tasks")).cast("int").alias("task"))
    of_doc = scratch.table(visits.groupBy("doc_id").agg(F.collect_list(visit).alias("visits"), F.flatten(F.collect_list("own")).alias("own")), "of-doc")
    some = docs.where("doc_id is not null")
    if of_doc.count() <= SEMI_JOIN_IDS:
        some = some.join(F.broadcast(of_doc.select("doc_id")), "doc_id", "left_semi")
    work = scratch.table(some.join(of_doc, "doc_id").withColumn("key", F.xxhash64("text", "doc_id")).dropDuplicates(["doc_id", "key"]), "work")

    texts_ = confirmed(work, window).join(shared, "phrase").select(shard, "words")
    texts_ = texts_.join(tasks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "words")
    runs = scratch.table(recurring_runs(work, texts_, window), "runs")
    first = scratch.table(runs.groupBy(*RUN).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "first-runs")
    judged = scratch.table(join_counted(runs, first, list(RUN)).select("doc_id", "key", "lo", "hi", (F.col("first") < F.col("doc_id")).alias("covered")), "judged")
    scratch.drop(runs, first)

    span = F.struct("lo", "hi")
    open_runs = judged.where("not covered").groupBy("doc_id", "key").agg(F.collect_list(span).alias("runs"))
    wins = scratch.table(windows_of(work.join(open_runs, ["doc_id", "key"]), window), "windows")
    first = wins.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("until"), F.count("*").alias("n")).where("first < until")
    first = scratch.table(first.select("h1", "h2", "first", "n"), "first-windows")
    late = join_counted(wins, first, ["h1", "h2"]).where("first < doc_id").select("doc_id", "key", F.col("at").cast("long").alias("lo"), (F.col("at") + window).cast("long").alias("hi"))
    whole = judged.where("covered").select("doc_id", "key", "lo", (F.col("hi") + window).alias("hi"))
    cuts = whole.unionByName(late).groupBy("doc_id", "key").agg(F.collect_list(span).alias("spans"))
    edited = scratch.table(kept(work.join(cuts, ["doc_id", "key"]).select("doc_id", "text", "spans"), texts), "edited")

    every = kept(docs.select("doc_id", "text"), texts)
    edited = edited.select("doc_id", "key", F.struct("n_removed", "kept_sha256", "kept").alias("e"))
    pick = lambda c: F.coalesce(F.col(f"e.{c}"), F.col(c)).alias(c)
    return every.join(edited, ["doc_id", "key"], "left").select("doc_id", "n_words", pick("n_removed"), pick("kept_sha256"), *([pick("kept")] if texts else []))
