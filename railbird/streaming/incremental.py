"""Incremental ingest: new text files since the last run, exactly once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.operators import audits, ingest
from railbird.plans import schema as S
from railbird.plans.stored import forget, stored
from railbird.sources import handtext

#: Bits of a filter for each of its ids, and bits that an id sets: about one absent id in 40 looks as if it were there.
BITS_PER_ID, PLACES = 8, 4
#: Bits of a filter's piece, the size of Spark's bitmaps; a filter has a power of two of them.
PIECE = 1 << 15
TABLES = ("hands", "players", "actions")


def ingest_new_files(spark: SparkSession, root: str, out: str, checkpoint: str, max_files: int | None = None, years: tuple[int, int] = S.STUDY_YEARS) -> None:
    """Parse the files under ``root`` that no earlier run has read and append to ``out/hands``, ``out/players`` and ``out/actions``.

    A file-source query with availableNow keeps the list of read files in ``checkpoint``. Hands whose id is
    already in the tables go to ``out/parse_errors`` as duplicates, rejected blocks and files without content as errors.

    A batch writes its tables into folders of its own (``batch=<run>-<number>``, the run named once in the checkpoint) and names itself in
    ``out/batches`` last of all. ``table`` reads named batches only, so a batch's rows come to be there together or not at all, and one that
    is run again after a failure replaces what it had written. A new checkpoint never overwrites what an earlier one wrote.

    A batch also leaves Bloom filters of its ids by year (``out/filters``) and sketches of its players (``out/sketches``). A later batch looks an id up in
    the batches and years only whose filters pass it, and reads no others; distinct players of all batches come from the sketches alone.
    """
    run = _run_name(spark, checkpoint)
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(root).select(F.col("path").alias("source_file"), handtext.decoded(F.col("content")).alias("value"))

    def batch(df: DataFrame, number: int) -> None:
        name = f"{run}-{number}"
        # Parsed once for all that is written of it.
        p = stored(ingest.parsed(ingest.folder_fields(ingest.blocks(df))).withColumn("year", F.year("timestamp").cast("long")))
        ok = p.filter("status = 'ok'").select("hand_id", "dataset", "year", "source_file", "block_no")
        first = ingest.first_wins(ok)
        again = stored(first.join(known_ids(spark, out, first.select("hand_id"), name), "hand_id", "left_semi").select("source_file", "hand_id", F.lit("duplicate").alias("error_type"), F.lit("seen before").alias("message")))
        fresh = stored(first.join(again.select("hand_id"), "hand_id", "left_anti").withColumn("hand_year", F.coalesce("year", F.lit(-1))))
        # Of the copies of a hand one block goes on, so hands, players and actions are of the same text.
        kept = stored(p.join(fresh.select("hand_id", "source_file", "block_no"), ["hand_id", "source_file", "block_no"], "left_semi"))
        of = fresh.select("hand_id", "hand_year")
        rows = dict(zip(TABLES, (ingest.hands_of(kept.drop("year"), years), ingest.players_of(kept), ingest.actions_of(kept))))
        for kind, t in rows.items():
            t.join(of, "hand_id").write.mode("overwrite").partitionBy("hand_year").parquet(f"{out}/{kind}/batch={name}")
        errors = ingest.rejects(p).unionByName(handtext.unreadable(df)).unionByName(again).unionByName(ingest.duplicates(ok))
        errors.write.mode("overwrite").parquet(f"{out}/parse_errors/batch={name}")
        filters(of).write.mode("overwrite").parquet(f"{out}/filters/batch={name}")
        written = [spark.read.parquet(f"{out}/{kind}/batch={name}") for kind in ("hands", "players")] if not fresh.isEmpty() else [rows["hands"], rows["players"]]
        audits.player_sketches(*written, years=years).write.mode("overwrite").parquet(f"{out}/sketches/batch={name}")
        spark.range(1).select(F.lit(name).alias("name")).write.mode("overwrite").parquet(f"{out}/batches/of={name}")
        forget(p, again, fresh, kept)

    q = files.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start()
    q.awaitTermination()


def _read(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.option("basePath", base) if base else spark.read).parquet(*paths)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _run_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of what this checkpoint writes, kept in the checkpoint."""
    path = f"{checkpoint}/run"
    if _read(spark, path) is None:
        spark.range(1).select(F.lit(uuid.uuid4().hex).alias("name")).write.parquet(path)
    return spark.read.parquet(path).first()["name"]


def _whole(spark: SparkSession, out: str) -> list[str]:
    """Names of the batches that are whole; as many as there are folders."""
    named = _read(spark, f"{out}/batches")
    return [] if named is None else [r["name"] for r in named.select("name").distinct().collect()]


def table(spark: SparkSession, out: str, kind: str = "hands") -> DataFrame:
    """hands, players, actions, parse_errors, filters or sketches of all whole batches; batch is its name. An error where no batch is whole."""
    return spark.read.option("basePath", f"{out}/{kind}").parquet(*[f"{out}/{kind}/batch={n}" for n in _whole(spark, out)])


def unique_players(spark: SparkSession, out: str) -> DataFrame:
    """Players, hands and seats by year, dataset and in total (``audits.unique_players``) from the batches' sketches; no hand is read."""
    return audits.unique_players_of(table(spark, out, "sketches"))


def _piece_and_places(pieces: Column) -> tuple[Column, Column]:
    """An id's piece of a filter of so many pieces, and the bits that it sets there."""
    h = F.xxhash64("hand_id", F.lit(1))
    places = F.array(*[F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(PIECE - 1).cast("long")) for i in range(PLACES)])
    return F.pmod(F.xxhash64("hand_id"), pieces), places


def filters(ids: DataFrame) -> DataFrame:
    """Bloom filters of ``ids(hand_id, hand_year)``: one row a piece, (hand_year, pieces, piece, bits)."""
    need = F.greatest(F.count("*") * BITS_PER_ID / PIECE, F.lit(1.0))
    per = ids.groupBy("hand_year").agg(F.pow(F.lit(2.0), F.ceil(F.log2(need))).cast("long").alias("pieces"))
    piece, places = _piece_and_places(F.col("pieces"))
    x = ids.join(F.broadcast(per), "hand_year")  # one row a year
    return x.select("hand_year", "pieces", piece.alias("piece"), F.explode(places).alias("at")).groupBy("hand_year", "pieces", "piece").agg(F.bitmap_construct_agg("at").alias("bits"))


def may_hold(ids: DataFrame, known: DataFrame) -> DataFrame:
    """(hand_id, batch, hand_year): the slices whose filters ``known(batch, hand_year, pieces, piece, bits)`` pass an id; every slice that holds it is among them.

    Pieces are powers of two, so there are a few sizes however many slices, and an id meets one piece of each slice in the join itself.
    """
    sizes = [r["pieces"] for r in known.select("pieces").distinct().collect()]
    x = ids.select("hand_id", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("pieces")) if sizes else ids.select("hand_id", F.lit(0).alias("pieces")).limit(0)
    piece, places = _piece_and_places(F.col("pieces"))
    x = x.select("hand_id", "pieces", piece.alias("piece"), places.alias("places"))
    byte = lambda at: F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.forall("places", lambda at: F.getbit(byte(at), at.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1)
    return x.join(known, ["pieces", "piece"]).filter(hit).select("hand_id", "batch", "hand_year")


def known_ids(spark: SparkSession, out: str, ids: DataFrame, batch: str) -> DataFrame:
    """Those of ``ids`` that the hands of whole batches other than ``batch`` hold; reads the slices that may hold one."""
    names = [n for n in _whole(spark, out) if n != batch]
    if not names:
        return ids.limit(0)
    known = _read(spark, *[f"{out}/filters/batch={n}" for n in names], base=f"{out}/filters")
    at = stored(may_hold(ids, known))
    slices = at.select("batch", "hand_year").distinct().collect()  # folders, as many as a listing of the table names
    if not slices:
        return ids.limit(0)
    return at.select("hand_id").join(_read(spark, *[f"{out}/hands/batch={r.batch}/hand_year={r.hand_year}" for r in slices], base=f"{out}/hands").select("hand_id"), "hand_id", "left_semi").distinct()
