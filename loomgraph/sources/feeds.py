"""Sources of feeds as Spark data sources: words come out, answers go back in.

A ``Source`` tells words in an order of its own, numbered by offsets, and
tells the same words again for the same bounds, so that Spark can read a piece
twice when an executor is lost. ``register`` makes a format of a function that
yields sources; ``spark.read`` of that format takes all that is told by now,
``spark.readStream`` goes on from the offsets in its checkpoint, one offset per
source, so a source that joins later begins at 0. Pieces are read side by side,
on executors. What the engine has to say of what it was told, rows of
``ANSWER``, is written to the same format and reaches the source's own methods
on executors, at least once each.

Defined results: a source without words gives none; two sources of one number
are refused; a word that comes with fewer fields than it needs is given as it
is, its missing fields null; answers for numbers that no source has are
refused, so that no failure is silent.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.feed import WORD

ANSWER = "source_id int, answer string, external_id string, level int, seq long, version string, scope int, payload string, reason string"
FIELDS = pa.schema([("source_id", pa.int32()), ("seq", pa.int64()), ("word", pa.string()), ("external_id", pa.string()), ("version", pa.string()), ("scope", pa.int32()), ("payload", pa.string())])


class Source(ABC):
    """Where observations come from; instances travel to executors."""

    source_id: int

    @abstractmethod
    def latest(self) -> int:
        """The offset after the last word there is; never falls."""

    @abstractmethod
    def words(self, start: int, end: int) -> Iterator[dict | pa.RecordBatch]:
        """The words from offset ``start`` up to before ``end``, as dicts or batches of the fields of a word but its source."""

    def pieces(self, start: int, end: int) -> Sequence[tuple[int, int]]:
        """Bounds within which words can be read by themselves."""
        return [(start, end)]

    def supplied(self) -> dict[str, int]:
        """Properties that are worth writing only from a level on."""
        return {}

    def level_changed(self, external_id: str, level: int) -> None:
        """How much of a thing is wanted from now on."""

    def release(self, end: int) -> None:
        """All words before ``end`` are taken and will not be asked for again."""

    @abstractmethod
    def rejected(self, observation: dict | None, reason: str) -> None:
        """An observation, or without one a state, that could not be mapped to writes."""


class Piece(InputPartition):
    def __init__(self, source: Source, start: int, end: int) -> None:
        self.source, self.start, self.end = source, start, end


def told(piece: Piece) -> Iterator[pa.RecordBatch]:
    """The words of a piece in batches, with their source."""
    rows: list[dict] = []

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        names = part.schema.names
        own = [pa.array([piece.source.source_id] * part.num_rows, pa.int32())]
        own += [part.column(names.index(f.name)).cast(f.type) if f.name in names else pa.nulls(part.num_rows, f.type) for f in list(FIELDS)[1:]]
        return pa.RecordBatch.from_arrays(own, schema=FIELDS)

    rest = pa.schema(list(FIELDS)[1:])
    for word in piece.source.words(piece.start, piece.end):
        if isinstance(word, dict):
            rows.append({n: word.get(n) for n in rest.names})
        if rows and (not isinstance(word, dict) or len(rows) == 4096):
            yield batch(pa.RecordBatch.from_pylist(rows, schema=rest))
            rows = []
        if not isinstance(word, dict):
            yield batch(word)
    if rows:
        yield batch(pa.RecordBatch.from_pylist(rows, schema=rest))


def cut_up(sources: Sequence[Source], start: dict, end: dict) -> list[Piece]:
    out = []
    for s in sources:
        a, b = start.get(str(s.source_id), 0), end.get(str(s.source_id), 0)
        if a < b:
            out += [Piece(s, x, y) for x, y in s.pieces(a, b) if x < y]
    return out


def now(sources: Sequence[Source]) -> dict:
    return {str(s.source_id): s.latest() for s in sources}


class Words(DataSourceReader):
    def __init__(self, sources: Sequence[Source]) -> None:
        self.sources = sources

    def partitions(self) -> Sequence[InputPartition]:
        # Spark wants one piece at least.
        return cut_up(self.sources, {}, now(self.sources)) or [Piece(Nothing(), 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return told(partition)


class WordStream(DataSourceStreamReader):
    def __init__(self, sources: Sequence[Source]) -> None:
        self.sources = sources

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return now(self.sources)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return cut_up(self.sources, start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return told(partition)

    def commit(self, end: dict) -> None:
        for s in self.sources:
            if str(s.source_id) in end:
                s.release(end[str(s.source_id)])


class Nothing(Source):
    source_id = -1

    def latest(self) -> int:
        return 0

    def words(self, start: int, end: int) -> Iterator[dict]:
        return iter(())

    def rejected(self, observation: dict | None, reason: str) -> None:
        raise ValueError(reason)


def answer(sources: Sequence[Source], rows: Iterator) -> WriterCommitMessage:
    by_id = {s.source_id: s for s in sources}
    for row in rows:
        source = by_id.get(row["source_id"])
        if source is None:
            raise ValueError(f"no source {row['source_id']}")
        if row["answer"] == "LEVEL":
            source.level_changed(row["external_id"], row["level"])
        elif row["answer"] == "REJECTED":
            seen = {n: row[n] for n in ("external_id", "seq", "version", "scope", "payload")}
            source.rejected(None if row["external_id"] is None else seen, row["reason"])
        else:
            raise ValueError(f"not an answer: {row['answer']}")
    return WriterCommitMessage()


class Answers(DataSourceWriter):
    def __init__(self, sources: Sequence[Source]) -> None:
        self.sources = sources

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        return answer(self.sources, iterator)


class AnswerStream(DataSourceStreamWriter):
    def __init__(self, sources: Sequence[Source]) -> None:
        self.sources = sources

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        return answer(self.sources, iterator)


def register(spark: SparkSession, format_name: str, make: Callable[[dict], Sequence[Source]]) -> None:
    """Make a format of the sources that ``make`` yields for the options of a read or write."""

    class Feeds(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def all(self) -> Sequence[Source]:
            found = list(make(dict(self.options)))
            if len({s.source_id for s in found}) < len(found):
                raise ValueError("two sources have one number")
            return found

        def schema(self) -> str:
            return WORD

        def reader(self, schema) -> DataSourceReader:
            return Words(self.all())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return WordStream(self.all())

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return Answers(self.all())

        def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
            return AnswerStream(self.all())

    spark.dataSource.register(Feeds)


def supplied(sources: Sequence[Source]) -> dict[int, dict[str, int]]:
    """What each source supplies from a level on, as ``assembly.materialize`` takes it."""
    return {s.source_id: s.supplied() for s in sources}


def rejections(tried: DataFrame) -> DataFrame:
    """Answers for observations with an ``error`` (``assembly.attempts``, ``assembly.tried``)."""
    return _answers(tried.where("error is not null").withColumn("reason", F.col("error")), "REJECTED")


def levels(before: DataFrame, after: DataFrame, entries: DataFrame) -> DataFrame:
    """Answers for entries (source_id, external_id, object_id) whose object is wanted at another level (object_id, level) than before.

    An object that was not wanted before, or is not now, counts as wanted at 0.
    An entry of several objects is wanted at the highest of their levels.
    """
    both = entries.join(before.withColumnRenamed("level", "_old"), "object_id", "left").join(after.withColumnRenamed("level", "_new"), "object_id", "left")
    most = both.groupBy("source_id", "external_id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("_old", "_new")])
    return _answers(most.where("_old <> _new").withColumn("level", F.col("_new")), "LEVEL")


def _answers(rows: DataFrame, kind: str) -> DataFrame:
    types = [c.split() for c in ANSWER.split(", ")]
    given = rows.withColumn("answer", F.lit(kind))
    return given.select(*[(F.col(n) if n in given.columns else F.lit(None)).cast(t).alias(n) for n, t in types])


class Lines(Source):
    """Words in a file of JSON lines that grows; offsets are line numbers.

    Answers are appended to the file beside it, ``<file>.answers``.
    """

    def __init__(self, source_id: int, path: str, supplied: dict[str, int] | None = None) -> None:
        self.source_id, self.path, self._supplied = source_id, path, supplied or {}

    def _whole(self) -> Iterator[str]:
        with open(self.path, encoding="utf-8") as lines:
            for line in lines:
                if line.endswith("\n"):  # one that is still being written comes later
                    yield line

    def latest(self) -> int:
        return sum(1 for _ in self._whole())

    def words(self, start: int, end: int) -> Iterator[dict]:
        for at, line in enumerate(self._whole()):
            if at >= end:
                return
            if at >= start:
                yield {"seq": at} | json.loads(line)

    def supplied(self) -> dict[str, int]:
        return self._supplied

    def _append(self, what: dict) -> None:
        with open(f"{self.path}.answers", "a", encoding="utf-8") as out:
            out.write(json.dumps(what) + "\n")

    def level_changed(self, external_id: str, level: int) -> None:
        self._append({"external_id": external_id, "level": level})

    def rejected(self, observation: dict | None, reason: str) -> None:
        self._append({"rejected": observation, "reason": reason})
