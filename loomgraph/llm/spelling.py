"""Spelling variants: words one edit apart, grouped under the commoner form.

Two words are near if one inserted, deleted or replaced code point leads from
one to the other. A word of length l is partitioned evenly into two segments.
An edit falls into one of them, so a near word holds the other one: at its own
place if it is the first, shifted by the difference of lengths if it is the
second. Both segments are indexed under the length and their place, and words
probe with their own substrings for partners as long as themselves, and for
partners one shorter.

What two words share so far is a key, and the part that is still open an
interval. Where a key holds more than ``MOST`` words, its interval is
partitioned evenly again, and the words go on under two keys that share more
of them; in the end one code point is open, and a key holds a few words of any
vocabulary. So no key's words meet in all pairs, and none are left out.
Candidates are verified inside the join, by one edit, and counted once each.

Runs of letters are counted per document and summed before they are shuffled.

Defined results: a null text holds no words; a null id counts as empty text in
the checksum; repeated rows count each; a word without near words is its own
root; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

RUN = "[A-Za-zÀ-ÿ]+"
BREAK = re.compile("[^A-Za-zÀ-ÿ]")
SLICE = 1 << 20  # code points of a text that are taken together
HELD = 1 << 17  # distinct words that a task sums before it passes them on
MOST = 64  # words under a key that meet each other
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(text: str) -> Iterator[str]:
    """``text`` in portions that cut no run of letters."""
    start = 0
    while len(text) - start > SLICE:
        found = BREAK.search(text, start + SLICE)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def typed(doc: str, run: str, every: int) -> str:
    """The lower-cased run, less one code point where the checksum says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, every: int = 199, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts of at least ``least_length`` code points and ``least_count`` occurrences."""
    runs = re.compile(RUN)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            long = [(w, n) for w, n in found.items() if len(w) >= least_length]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in long], pa.string()), pa.array([n for _, n in long], pa.int64())], ["word", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                doc, text = batch.column(0)[i].as_py() or "", batch.column(1)[i].as_py()
                for part in slices(text) if text else ():
                    own: Counter = Counter()
                    for run, n in Counter(runs.findall(part)).items():
                        own[run.translate(LOWER)] += n
                    for run, n in own.items():
                        found[typed(doc, run, every)] += n
                    if len(found) > HELD:
                        yield rows()
        yield rows()

    each = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(counted, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def near_words(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """(a, a_n, b, b_n): each two near words of ``vocabulary(word, n)`` once.

    ``first`` and ``last`` bound the open interval of the shorter word, of
    length ``size``; ``shift`` is 1 where a word probes for shorter ones.
    """
    start, stop, shift = F.col("first"), F.col("last"), F.col("shift")
    shared = F.concat(F.substring("word", F.lit(1), start), F.lit("\0"), F.substring("word", stop + shift + 1, F.length("word")))

    def halves(rows: DataFrame) -> DataFrame:
        half = start + F.floor((stop - start) / 2).cast("int")
        two = F.array(F.struct(start.alias("first"), half.alias("last")), F.struct(half.alias("first"), stop.alias("last")))
        parts = rows.select("word", "n", "size", "shift", F.explode(F.filter(two, lambda x: x["last"] > x["first"])).alias("_part"))
        return parts.select("word", "n", "size", "shift", "_part.*")

    length = F.length("word")
    whole = vocabulary.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("shift"))
    whole = whole.select("word", "n", (length - F.col("shift")).alias("size"), "shift", F.lit(0).alias("first"), (length - F.col("shift")).alias("last")).where("size > 0")
    open_rows, found = halves(whole), None
    while True:
        rows = cut(open_rows.withColumn("shared", shared))
        key = ["size", "first", "last", "shared"]
        sizes = rows.groupBy(*key).agg(F.count_if(F.col("shift") == 0).alias("_own"), F.count(F.lit(1)).alias("_all"))
        # Where no word of the length is indexed nothing can be found, nor where only one is and nothing probes.
        useful = sizes.where("_own > 0 and _all > 1")
        kept = cut(rows.join(useful, key).withColumn("hot", (F.col("_all") > most) & (stop - start > 1)).drop("_own", "_all"))
        cold = kept.where("not hot")
        index = cold.where("shift = 0").select(*key, F.col("word").alias("a"), F.col("n").alias("a_n"))
        probe = cold.select(*key, "shift", F.col("word").alias("b"), F.col("n").alias("b_n"))
        one_edit = ((shift == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
        pairs = index.join(probe, key).where(one_edit).select("a", "a_n", "b", "b_n")
        found = pairs if found is None else found.unionByName(pairs)
        hot = kept.where("hot").drop("hot", "shared")
        if hot.isEmpty():
            # An insertion next to an equal code point is found in both halves.
            return found.distinct()
        open_rows = halves(hot)


def variants(vocabulary: DataFrame, times: int = 5, most: int = MOST) -> DataFrame:
    """Each word with its near word of largest n, if that is ``times`` as common, and with the last word of that chain."""
    vocabulary = cut(vocabulary)
    pairs = near_words(vocabulary, most)
    both = pairs.select(F.col("a").alias("w"), F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("form")).alias("x")).unionByName(
        pairs.select(F.col("b").alias("w"), F.struct((-F.col("a_n")).alias("m"), F.col("a").alias("form")).alias("x"))
    )
    best = both.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min("x").alias("x"))
    joined = vocabulary.join(best, F.col("word") == F.col("w"), "left")
    common = -F.col("x.m") >= times * F.col("n")
    rows = cut(
        joined.select(
            "word",
            F.when(common, F.col("x.form")).alias("form"),
            "n",
            F.coalesce(F.col("n_near"), F.lit(0)).alias("n_near"),
            F.when(common, -F.col("x.m")).alias("form_n"),
        )
    )
    # A form is at least ``times`` as common, so chains are short; each round doubles how far a root lies.
    jumps = cut(rows.where("form is not null").select(F.col("word").alias("u"), F.col("form").alias("v")))
    while True:
        on = jumps.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
        further = cut(jumps.join(on, F.col("v") == F.col("_u"), "left").select("u", F.coalesce("_v", "v").alias("v"), F.col("_v").isNotNull().alias("moved")))
        jumps = further.select("u", "v")
        if further.where("moved").isEmpty():
            break
    out = rows.join(jumps, F.col("word") == F.col("u"), "left")
    return out.select("word", "form", F.coalesce("v", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, sf_dir: str) -> DataFrame:
    return variants(words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: Documents' runs with the checksum worked out byte by byte, then all words under each word's shortened forms.
OP11_SQL = """
with recursive step(i, k, c) as (
  select i, 0, i from range(256) t(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8
), tab as (select list(c order by i) as tab from step where k = 8),
runs as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as k
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) group by 1, 2
), bytes as (
  select run, k, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from runs
), sums as (
  select run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(cast(length(x) / 2 as bigint)), lambda i: cast(('0x' || substr(x, 2 * i + 1, 2)) as bigint))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as h from bytes, tab
), vocabulary as (
  select case when h % 199 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, cast(sum(k) as bigint) as n
  from sums group by 1 having length(word) >= 6 and sum(k) >= 5
), cuts as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as less from (select word, n, unnest(range(length(word))) as i from vocabulary)
), pairs as (
  select a.word as word, b.word as near, b.n as near_n from cuts a join cuts b on a.i = b.i and a.less = b.less and length(a.word) = length(b.word) and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join vocabulary b on a.less = b.word
  union select b.word, a.word, a.n from cuts a join vocabulary b on a.less = b.word
), best as (
  select word, count(*) as n_near, max(near_n) as m, min(near) filter (near_n = top) as form from (select *, max(near_n) over (partition by word) as top from pairs) group by word
), forms as (
  select v.word, case when m >= 5 * n then form end as form, n, coalesce(n_near, 0) as n_near, case when m >= 5 * n then m end as form_n from vocabulary v left join best using (word)
), chain(word, root, form) as (
  select word, word, form from forms
  union all
  select c.word, f.word, f.form from chain c join forms f on c.form = f.word
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from forms f join chain c on c.word = f.word where c.form is null
"""
