"""Spelling variant grouping by a dictionary of trie-node pairs (operator 13).

The words are sorted and streamed through a forward trie; the reversed words through a second one.
Every node gets a number: new ones as a word leaves the path of the word before it, so a task holds one
path at a time, whatever the size of a subtree. A range partition starts with the numbers of the path
that the partitions before it ended on (``_number``), so equal prefixes have equal numbers everywhere.

A word of m characters stands in the dictionary under m + 1 pairs (prefix node i, suffix node m - i),
which spell the word itself, and under m pairs (prefix node i, suffix node m - 1 - i) that skip
character i. Two words differ by one replaced character if they share a skipping pair; one is the other
with a character deleted if a skipping pair of the longer is a spelling pair of the shorter. Node
numbers are unique, so the pairs give exactly the neighbours. A deletion inside a run of equal
characters gives one word from every place of the run: only the first place counts, so each neighbour
is met once. The words under one pair are at most one that spells it and one for each character of the
alphabet (91 here), which bounds every group.

Counting is pre-aggregated per document and per task. A hot source, many copies or a word that stands in
every document therefore add one row per task.

Edge cases: NULL text has no words; a NULL ``doc_id`` counts as an empty id in the contract's rule;
repeated rows count as often as they stand; an empty table gives an empty result; other columns of any
name take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ready

MIN_LENGTH = 6
MIN_COUNT = 5
#: A word's form occurs at least so many times as often as the word.
RATIO = 5
#: Distinct words that a task holds before it passes their counts on.
FLUSH = 500_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_ROOT = -1
#: Bits of a node's or word's number inside its partition.
_LOCAL = 40

Rule = Callable[[object, str], str]


def drop_letter(doc_id, word: str, every: int = 199) -> str:
    """``word`` without one code point where ``every`` divides the crc32 of ``<doc_id>:<word>``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, rule: Rule | None = None, min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters of the whole texts, A-Z lower-cased, then changed by ``rule``."""
    def run(batches):
        total: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                own: Counter = Counter()
                for w, n in Counter(_RUN.findall(text.as_py() or "")).items():
                    own[w.translate(_LOWER)] += n
                doc_id = doc_id.as_py()
                for w, n in own.items():
                    if rule:
                        w = rule(doc_id, w)
                    if len(w) >= min_length:
                        total[w] += n
                if len(total) >= FLUSH:
                    yield out()
        yield out()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _number(words: DataFrame) -> DataFrame:
    """(word, id, nodes): trie node numbers of every prefix of ``key`` but the empty one.

    ``words`` has (word, key). ``id`` grows with ``key`` in code-point order. The driver sees the first
    and the last key of each partition.
    """
    def run(batches):
        part = TaskContext.get().partitionId() << _LOCAL
        first = last = None
        path: list[int] = []
        nodes = rows = 0
        for batch in batches:
            keys = batch.column("key").to_pylist()
            ids, paths = [], []
            for key in keys:
                if first is None:
                    first, last = key, ""
                keep = _shared(last, key)
                path = path[:keep] + [part + nodes + i for i in range(len(key) - keep)]
                nodes += len(key) - keep
                last = key
                ids.append(part + rows)
                paths.append(path)
                rows += 1
            none = pa.nulls(len(keys), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.int64())), none, none],
                names=["word", "id", "nodes", "first", "last"])
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.string()), pa.array([part], pa.int64()), pa.array([path], pa.list_(pa.int64())),
                 pa.array([first]), pa.array([last])], names=["word", "id", "nodes", "first", "last"])

    ordered = words.select("word", "key").repartitionByRange("key").sortWithinPartitions("key")
    done = materialise(ordered.mapInArrow(
        run, "word string, id long, nodes array<long>, first string, last string"), "trie")
    edges = sorted(done.where("first is not null").select("id", "nodes", "first", "last").collect())
    opening, before, ends = [], "", []
    for e in edges:
        keep = _shared(before, e.first)
        known = ends[:keep]
        opening.append((e.id, known))
        # the path a partition ends on, in final numbers
        ends = [known[d] if d < keep and x == e.id + d else x for d, x in enumerate(e.nodes)]
        before = e.last
    known = F.broadcast(words.sparkSession.createDataFrame(opening, "part long, known array<long>"))
    part = F.shiftleft(F.shiftright("id", _LOCAL), _LOCAL)
    return done.where("word is not null").join(known, part == known["part"]).select(
        "word", "id", F.transform("nodes", lambda x, d: F.when(
            (d < F.size("known")) & (x == F.col("part") + d), F.get("known", d)).otherwise(x)).alias("nodes"))


def pair_dictionary(words: DataFrame) -> DataFrame:
    """(prefix, suffix, id, n, skip) of every word of (word, n).

    ``skip`` is 0 where the pair spells the word, 1 where it leaves a character out, 2 where the same word
    results from leaving out the character before. ``id`` numbers the words in code-point order.
    """
    forward = _number(words.select("word", F.col("word").alias("key")))
    backward = _number(words.select("word", F.reverse("word").alias("key")))
    root = F.array(F.lit(_ROOT).cast("long"))
    whole = (words.join(forward, "word")
             .join(backward.select("word", F.col("nodes").alias("ends")), "word")
             .select("word", "n", "id", F.concat(root, "nodes").alias("pre"), F.concat(root, "ends").alias("suf"),
                     F.filter(F.split("word", ""), lambda c: c != "").alias("chars")))
    return materialise(whole, "numbered")


def _pairs(numbered: DataFrame) -> DataFrame:
    m = F.size("chars")
    pre, suf, chars = F.col("pre"), F.col("suf"), F.col("chars")

    def pair(i, j, skip):
        return F.struct(F.get(pre, i).alias("prefix"), F.get(suf, j).alias("suffix"), skip.alias("skip"))

    spelled = F.transform(pre, lambda _, i: pair(i, m - i, F.lit(0)))
    skipped = F.transform(chars, lambda c, i: pair(i, m - 1 - i, F.when(
        (i > 0) & (c == F.get(chars, i - 1)), F.lit(2)).otherwise(F.lit(1))))
    return numbered.select("id", "n", F.explode(F.concat(spelled, skipped)).alias("pair")).select(
        "pair.prefix", "pair.suffix", "id", "n", "pair.skip")


def neighbours(numbered: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near, and the most frequent of them as (n, -id)."""
    met = (_pairs(numbered).groupBy("prefix", "suffix")
           .agg(F.collect_list(F.struct("n", "id", "skip")).alias("all")).where(F.size("all") > 1))

    def near(x):
        return F.transform(
            F.filter("all", lambda y: (y["id"] != x["id"]) & ((x["skip"] * y["skip"] > 0) | (x["skip"] + y["skip"] == 1))),
            lambda y: F.struct(y["n"].alias("n"), (-y["id"]).alias("minus")))

    own = met.select(F.explode(F.transform("all", lambda x: F.struct(x["id"].alias("id"), near(x).alias("near")))).alias("m"))
    return (own.where(F.size("m.near") > 0)
            .select("m.id", F.size("m.near").alias("k"), F.array_max("m.near").alias("best"))
            .groupBy("id").agg(F.sum("k").cast("long").alias("n_near"), F.max("best").alias("best")))


def _roots(links: DataFrame) -> DataFrame:
    """(id, root) for (id, up): the end of each chain, every round doubling the step.

    A form is ``RATIO`` times as frequent as its word, so chains are short (27 links reach 2**63).
    """
    current = materialise(links.select("id", F.col("up").alias("root")), "roots")
    while True:
        above = current.select(F.col("id").alias("root"), F.col("root").alias("top"))
        step = materialise(current.join(above, "root", "left").select(
            "id", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("id", "root")
        current = step.select("id", "root")


def variant_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Form and root of every word of (word, n): ``word, form, root, n, n_near, form_n``.

    ``form`` is the most frequent word at one inserted, deleted or replaced character (ties: the smallest),
    if it occurs at least ``ratio`` times as often as the word.
    """
    ready(words.sparkSession)
    words = materialise(words.select("word", "n"), "words")
    numbered = pair_dictionary(words)
    found = materialise(numbered.select("id", "word", "n").join(neighbours(numbered), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), F.struct((-F.col("best.minus")).alias("up"),
                                                               F.col("best.n").alias("n"))).alias("above")), "near")
    roots = _roots(found.where("above is not null").select("id", F.col("above.up").alias("up")))
    name = found.select(F.col("id").alias("up"), F.col("word").alias("form"))
    top = found.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    linked = (found.where("above is not null").select("id", F.col("above.up").alias("up"), F.col("above.n").alias("form_n"))
              .join(name, "up").join(roots, "id").join(top, "root").select("id", "form", "root_word", "form_n"))
    return found.join(linked, "id", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, rule: Rule | None = None, min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """``variant_forms`` of the words of ``docs`` (see ``word_counts``)."""
    ready(docs.sparkSession)
    return variant_forms(word_counts(docs, rule, min_length, min_count), ratio)
