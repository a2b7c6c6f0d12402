"""The engine's registered queries over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

import foldwise
from foldwise.functions import codecs, hashes, jpeg, tans
from foldwise.functions.bits import Damaged
from foldwise.operators import delta, detect, sketch, stats
from foldwise.config import DedupConfig
from foldwise.plans import archive
from foldwise.plans.freeze import frozen
from foldwise.sources import ordered, rendered, records

PATCH = 20_000
#: Bytes of a batch of documents in base detection; bases are looked for within a batch only.
BATCH = 500_000
_all: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def keep(f):
        _all[f.__name__] = (f, sql)
        return f

    return keep


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.exploded(frozen(sketch.sketches(_docs(spark, sf_dir)), "sketches"))


def _batched_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots with the batch of their document: in order of doc_id a batch closes when it has BATCH bytes."""
    docs = _docs(spark, sf_dir)
    batches = records.fixed_batches(docs.select("doc_id", F.octet_length("text").alias("size")), BATCH, ["doc_id"]).select(F.col("doc_id").alias("id"), "batch")
    return sketch.exploded(frozen(sketch.sketches(docs), "sketches").join(batches, "id"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.candidates(_batched_slots(spark, sf_dir), within=("batch",))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frozen(detect.best_base(_pairs(spark, sf_dir)), "best")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.cells(_docs(spark, sf_dir))


_CELLS = """cells AS (
  SELECT id, y, x - 1 AS x, w[x] AS block, ('0x' || substr(md5(w[x]), 1, 7))::BIGINT AS h FROM (
    SELECT id, y - 1 AS y, string_split(l[y], ' ') AS w, unnest(range(1, len(string_split(l[y], ' ')) + 1)) AS x FROM (
      SELECT doc_id AS id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS y FROM documents WHERE text IS NOT NULL)))"""
_KS = ", ".join(f"({k}, {a}::BIGINT, {b}::BIGINT)" for k, (a, b) in enumerate(map(sketch.slot, range(sketch.SLOTS))))
_HS = ", ".join(f"lead(h, {i}) OVER w AS h{i}" for i in range(4))
_SLOTS = f"""{_CELLS}, win AS (
  SELECT id, y * 4294967296 + x AS pos, (h0 & 127) * 2097152 + (h1 & 127) * 16384 + (h2 & 127) * 128 + (h3 & 127) AS v FROM (
    SELECT id, y, x, {_HS} FROM cells WINDOW w AS (PARTITION BY id, y ORDER BY x)) WHERE h3 IS NOT NULL
), ks(k, a, b) AS (VALUES {_KS}), val AS (
  SELECT id, k, pos, (v * a + b) % 2147483647 AS sf FROM win, ks
), slots AS (
  SELECT id, k, max(sf) AS sf, arg_max(pos, sf * 9223372036854775808::HUGEINT - pos) AS pos FROM val GROUP BY id, k
)"""


def _filled(rows: str, patch: int) -> str:
    """CTEs that end in filled (n, batch): rows (n, size) fill a batch up to ``patch`` bytes, then the next begins."""
    return f"""numbered AS ({rows}), filled AS (
  SELECT n, size AS held, 0::BIGINT AS batch FROM numbered WHERE n = 1
  UNION ALL SELECT s.n, CASE WHEN f.held >= {patch} THEN s.size ELSE f.held + s.size END, CASE WHEN f.held >= {patch} THEN f.batch + 1 ELSE f.batch END FROM filled f JOIN numbered s ON s.n = f.n + 1
)"""


_BATCHES = _filled("SELECT doc_id AS id, coalesce(strlen(text), 0)::BIGINT AS size, row_number() OVER (ORDER BY doc_id) AS n FROM documents", BATCH)
_PAIRS = f"""{_SLOTS}, {_BATCHES}, placed AS (
  SELECT s.*, f.batch FROM slots s JOIN numbered USING (id) JOIN filled f USING (n)
), sk AS (
  SELECT id, batch, string_agg(sf::VARCHAR, ',' ORDER BY k) AS s FROM placed GROUP BY id, batch
), firsts AS (SELECT min(id) AS id FROM sk GROUP BY s, batch
), pairs AS (
  SELECT t.id AS t, b.id AS b, count(*) AS score, min(t.k) AS first_k, max((t.pos = b.pos)::INT) AS same_pos
  FROM placed t JOIN placed b ON t.batch = b.batch AND t.k = b.k AND t.sf = b.sf AND b.id < t.id JOIN firsts f ON f.id = b.id GROUP BY ALL
)"""
_BEST = f"""{_PAIRS}, best AS (
  SELECT t, b, score, first_k, 1 - same_pos AS fix_flag FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, first_k, b) AS r FROM pairs) WHERE r = 1
)"""
_BLOCKS = "blocks AS (SELECT vec_id, list_transform(embedding, lambda v: round(v::DOUBLE * 127)::INT) AS c FROM embeddings)"
_FIXED = f"""{_BEST}, marked AS (
  SELECT best.t, best.b, c.y, c.x, CASE WHEN c.block = d.block THEN 'COPY' ELSE 'INSERT' END AS op
  FROM best JOIN cells c ON c.id = best.t LEFT JOIN cells d ON d.id = best.b AND d.y = c.y AND d.x = c.x
), runs AS (
  SELECT t, y, op, min(x) AS x, count(*) AS len FROM (SELECT *, x - row_number() OVER (PARTITION BY t, y, op ORDER BY x) AS island FROM marked) GROUP BY t, y, op, island
)"""


@query("SELECT d.doc_id AS target, f.base FROM documents d JOIN (SELECT md5(text) AS m, min(doc_id) AS base FROM documents GROUP BY 1) f ON md5(d.text) = f.m WHERE d.doc_id > f.base")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exact_duplicates(_docs(spark, sf_dir))


@query("SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY source")
def scan_files_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


@query("SELECT doc_id, source, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) IS NULL AS end_of_dir FROM documents")
def scan_end_of_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.with_end_of_dir(_docs(spark, sf_dir).select("doc_id", "source"))


@query(f"""WITH RECURSIVE {_filled("SELECT doc_id, source, coalesce(strlen(text), 0)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS n FROM documents", PATCH)}
SELECT doc_id, source, batch FROM numbered JOIN filled USING (n)""")
def batch_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _docs(spark, sf_dir).select("doc_id", "source", F.octet_length("text").alias("size"))
    return records.fixed_batches(sized, PATCH, ["source", "doc_id"]).select("doc_id", "source", "batch")


@query(f"""WITH RECURSIVE {_filled("SELECT source AS dir, sum(strlen(text))::BIGINT AS size, row_number() OVER (ORDER BY source NULLS FIRST) AS n FROM documents GROUP BY source", 10 * PATCH)}
SELECT dir, size AS bytes, batch FROM numbered JOIN filled USING (n)""")
def batch_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _docs(spark, sf_dir).select("source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    return records.variable_batches(sized, 10 * PATCH)


@query("SELECT doc_id, source FROM documents WHERE length(text) >= 64 AND text LIKE '%.'")
def valid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(records.valid(F.col("text"))).select("doc_id", "source")


@query("SELECT doc_id, source, text FROM documents WHERE NOT coalesce(length(text) >= 64 AND text LIKE '%.', false)")
def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(~F.coalesce(records.valid(F.col("text")), F.lit(False))).select("doc_id", "source", "text")


@query(f"WITH {_CELLS} SELECT id, count(*) AS cells, max(y) + 1 AS rows_, max(x) + 1 AS columns_, sum(h)::BIGINT AS checksum FROM cells GROUP BY id")
def grid_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("id").agg(F.count("*").alias("cells"), (F.max("y") + 1).alias("rows_"), (F.max("x") + 1).alias("columns_"), F.sum("h").alias("checksum"))


def _bitmap_sql(picks: list[int]) -> str:
    return f"WITH {_BLOCKS} SELECT vec_id, {' + '.join(f'(c[{i + 1}] & 1) * {1 << (len(picks) - 1 - n)}' for n, i in enumerate(picks))} AS bitmap FROM blocks"


_CORNER, _SPREAD = [8 * r + c for r in range(4) for c in range(4)], list(range(0, 64, 4))


def _bitmap(spark: SparkSession, sf_dir: str, picks: list[int]) -> DataFrame:
    bits = sum((F.get("c", i).bitwiseAND(1) * (1 << (len(picks) - 1 - n)) for n, i in enumerate(picks[1:], 1)), F.get("c", picks[0]).bitwiseAND(1) * (1 << (len(picks) - 1)))
    return records.blocks(records.table(spark, sf_dir, "embeddings")).select("vec_id", bits.alias("bitmap"))


@query(_bitmap_sql(_CORNER))
def bitmap_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bitmap(spark, sf_dir, _CORNER)


@query(_bitmap_sql(_SPREAD))
def bitmap_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bitmap(spark, sf_dir, _SPREAD)


@query(f"WITH {_SLOTS} SELECT id, k, sf, pos FROM slots")
def sketch_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir)


@query(f"""WITH {_CELLS}, win AS (
  SELECT a.id, a.y * 4294967296 + a.x AS pos, (a.h & 127) * 2097152 + (c.h & 127) * 16384 + (b.h & 127) * 128 + (d.h & 127) AS v
  FROM cells a JOIN cells b ON b.id = a.id AND b.y = a.y AND b.x = a.x + 1 JOIN cells c ON c.id = a.id AND c.y = a.y + 1 AND c.x = a.x JOIN cells d ON d.id = a.id AND d.y = a.y + 1 AND d.x = a.x + 1
), ks(k, a, b) AS (VALUES {_KS}), val AS (SELECT id, k, pos, (v * a + b) % 2147483647 AS sf FROM win, ks)
SELECT id, k, max(sf) AS sf, arg_max(pos, sf * 9223372036854775808::HUGEINT - pos) AS pos FROM val GROUP BY id, k""")
def sketch_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.exploded(sketch.sketches(_docs(spark, sf_dir), sketch.windows_2d))


@query(f"WITH {_SLOTS} SELECT id, (k // 2)::INT AS k, sum(sf)::BIGINT AS sf FROM slots GROUP BY 1, 2")
def super_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.super_features(_slots(spark, sf_dir))


@query(f"WITH RECURSIVE {_PAIRS} SELECT t, b, score, first_k, same_pos FROM pairs")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"WITH RECURSIVE {_BEST} SELECT t, b, score, first_k FROM best")
def best_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("t", "b", "score", "first_k")


@query(f"WITH RECURSIVE {_PAIRS} SELECT t, b, row_number() OVER (PARTITION BY t ORDER BY score DESC, first_k, b) AS rank FROM pairs")
def base_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of a target in order of preference."""
    return detect.with_rank(_pairs(spark, sf_dir)).select("t", "b", F.col("rank").cast("long").alias("rank"))


@query(f"WITH RECURSIVE {_BEST} SELECT t, b, fix_flag FROM best")
def fix_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("t", "b", "fix_flag")


@query(f"WITH RECURSIVE {_BEST} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT t FROM best)")
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.unmatched(_docs(spark, sf_dir), _best(spark, sf_dir)).select("doc_id", "source")


@query(f"WITH RECURSIVE {_BEST} SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT t FROM best)")
def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.matched(_docs(spark, sf_dir), _best(spark, sf_dir)).select("doc_id", "source")


_ADLER = """WITH o AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS hx, unnest(range(0, strlen(text))) AS i, strlen(text) AS n FROM documents WHERE strlen(text) > 0)
SELECT doc_id, (((sum((n - i) * ('0x' || hx)::BIGINT) + any_value(n)) % 65521)::BIGINT << 16) + ((1 + sum(('0x' || hx)::BIGINT)) % 65521)::BIGINT AS adler FROM o GROUP BY doc_id
UNION ALL SELECT doc_id, CASE WHEN text IS NOT NULL THEN 1 END AS adler FROM documents WHERE coalesce(strlen(text), 0) = 0"""


@query(_ADLER)
def adler32_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.when(F.col("text").isNotNull(), hashes.adler32_column(hashes.octets(F.col("text")))).alias("adler"))


@query(_ADLER)
def adler32_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksums of two halves of each text, put together."""
    half = F.floor(F.length("text") / 2).cast("int")
    parts = _docs(spark, sf_dir).select("doc_id", F.substring("text", F.lit(1), half).alias("one"), F.substring("text", half + 1, F.length("text")).alias("two"))
    sums = parts.select("doc_id", *[F.when(F.col(c).isNotNull(), hashes.adler32_column(hashes.octets(F.col(c)))).alias(c) for c in ("one", "two")], F.octet_length("two").cast("long").alias("length"))
    return sums.select("doc_id", hashes.adler32_combine_column(F.col("one"), F.col("two"), F.col("length")).alias("adler"))


@query(f"WITH {_BLOCKS} SELECT vec_id, ((c[1]::BIGINT << 24) | (c[9]::BIGINT & 65280) | (c[10]::BIGINT & 255)) & 4294967295 AS h FROM (SELECT vec_id, list_transform(c, lambda v: v & 4294967295::BIGINT) AS c FROM blocks)")
def dc_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.blocks(records.table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", hashes.dc_hash_column(F.col("c")).bitwiseAND(0xFFFFFFFF).alias("h"))


@query(f"WITH {_BLOCKS} SELECT vec_id, array_to_string(list_transform(c, lambda v: v & 1), '') AS bits FROM blocks")
def parity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The low bits of a block's coefficients, the first one first."""
    rows = records.blocks(records.table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", hashes.parity_hash_column(F.col("c")).alias("bits"))


def _byte_sketch(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    foldwise.ship(spark)

    @pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        rabin, out = hashes.Rabin(RABIN_WINDOW), []
        a, b = sketch.multipliers(4)
        for text in texts:
            data = (text or "").encode()
            x = rabin.windows(data) if method == "rabin" else hashes.gear(data)[63:]
            with np.errstate(over="ignore"):
                out.append([int((x * a[m] + b[m]).max().view(np.int64)) if len(x) else 0 for m in range(4)])
        return pd.Series(out)

    return _docs(spark, sf_dir).select("doc_id", of("text").alias("sf")).select("doc_id", *[F.get("sf", m).alias(f"sf{m}") for m in range(4)])


RABIN_WINDOW = 8


def _rabin_sql() -> str:
    """Digests as exclusive ors of each byte's residue at its place, which is one of its bits' residues; features modulo 2**64."""
    n, rabin = RABIN_WINDOW, hashes.Rabin(RABIN_WINDOW)
    bits = ", ".join(f"({place}, {bit}, {int(table[1 << bit])}::BIGINT)" for place, table in enumerate(rabin._place_tables()) for bit in range(8))
    digest = "t[1][b0 + 1]"
    for k in range(1, n):
        digest = f"xor({digest}, t[{k + 1}][b{k} + 1])"
    values = ", ".join(f"coalesce(max((x::UHUGEINT * {int(a)}::UHUGEINT + {int(b)}::UHUGEINT) & 18446744073709551615::UHUGEINT), 0)::HUGEINT AS f{m}" for m, (a, b) in enumerate(zip(*sketch.multipliers(4), strict=True)))
    signed = ", ".join(f"(f{m} - CASE WHEN f{m} >= 9223372036854775808::HUGEINT THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT AS sf{m}" for m in range(4))
    return f"""WITH bits(place, bit, v) AS (VALUES {bits}), entries AS (
  SELECT place, byte, bit_xor(CASE WHEN (byte >> bit) & 1 = 1 THEN v ELSE 0 END) AS v FROM bits, range(256) r(byte) GROUP BY place, byte
), places AS (SELECT place, list(v ORDER BY byte) AS l FROM entries GROUP BY place), tables AS (SELECT list(l ORDER BY place) AS t FROM places
), octets AS (SELECT doc_id, unnest(range(0, strlen(text))) AS i, ('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')))::INT AS b0 FROM documents WHERE strlen(text) > 0
), runs AS (SELECT doc_id, b0, {", ".join(f"lead(b0, {k}) OVER w AS b{k}" for k in range(1, n))} FROM octets WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), digests AS (SELECT doc_id, {digest} AS x FROM runs, tables WHERE b{n - 1} IS NOT NULL
), f AS (SELECT documents.doc_id, {values} FROM documents LEFT JOIN digests ON digests.doc_id = documents.doc_id GROUP BY documents.doc_id
) SELECT doc_id, {signed} FROM f"""


@query(_rabin_sql())
def rabin_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _byte_sketch(spark, sf_dir, "rabin")


@query()
def gear_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _byte_sketch(spark, sf_dir, "gear")


@query(f"""WITH {_CELLS} SELECT id, count(*) AS blocks, sum((p IS NULL OR p <> h)::INT)::BIGINT AS indexed, sum(CASE WHEN p IS NULL OR p <> h THEN h ELSE 0 END)::BIGINT AS checksum
FROM (SELECT *, lag(h) OVER (PARTITION BY id, y ORDER BY x) AS p FROM cells) GROUP BY id""")
def block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _cells(spark, sf_dir)
    kept = delta.block_index(every).groupBy("id").agg(F.count("*").alias("indexed"), F.sum("h").alias("checksum"))
    return every.groupBy("id").agg(F.count("*").alias("blocks")).join(kept, "id")


@query(f"""WITH RECURSIVE {_BEST} SELECT best.t, count(*) AS cells, sum((EXISTS (SELECT 1 FROM cells d WHERE d.id = best.b AND d.block = c.block))::INT)::BIGINT AS matched
FROM best JOIN cells c ON c.id = best.t GROUP BY best.t""")
def block_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.matched_cells(_pairs_with_text(spark, sf_dir))


@query(f"WITH RECURSIVE {_FIXED} SELECT t, y, op, x, len FROM runs")
def fixed_point_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.fixed_point(_pairs_with_text(spark, sf_dir))


def _pairs_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    best = _best(spark, sf_dir)
    return best.join(docs.select(F.col("doc_id").alias("t"), F.col("text").alias("target")), "t").join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("base")), "b")


_COPIED = """copied AS (
  SELECT best.t, best.fix_flag, count(*) AS cells, sum(CASE WHEN best.fix_flag = 1 THEN EXISTS (SELECT 1 FROM cells d WHERE d.id = best.b AND d.block = c.block) ELSE EXISTS (SELECT 1 FROM cells d WHERE d.id = best.b AND d.y = c.y AND d.x = c.x AND d.block = c.block) END::INT)::BIGINT AS copied
  FROM best JOIN cells c ON c.id = best.t GROUP BY best.t, best.fix_flag
)"""


@query(f"WITH RECURSIVE {_BEST}, {_COPIED} SELECT t, copied, cells - copied AS inserted, md5(d.text) AS restored_md5 FROM copied JOIN documents d ON d.doc_id = copied.t")
def greedy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target is coded against its base and replayed; the digest is that of the replayed text."""
    foldwise.ship(spark)
    return delta.greedy(_pairs_with_text(spark, sf_dir)).select("t", "copied", "inserted", "restored_md5")


@query()
def delta_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of copy instructions of each target: the greedy parse itself."""
    foldwise.ship(spark)
    return delta.greedy(_pairs_with_text(spark, sf_dir)).select("t", "copies", "restored")


@pandas_udf(BinaryType())
def _byte_delta(base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([codecs.delta_bytes(b.encode(), t.encode()) for b, t in zip(base, target, strict=True)])


@pandas_udf(StringType())
def _byte_restored(base: pd.Series, packed: pd.Series) -> pd.Series:
    return pd.Series([codecs.undelta_bytes(b.encode(), bytes(p)).decode() for b, p in zip(base, packed, strict=True)])


@pandas_udf(BinaryType())
def _byte_composed(one: pd.Series, two: pd.Series) -> pd.Series:
    return pd.Series([codecs.composed_delta(bytes(a), bytes(b)) for a, b in zip(one, two, strict=True)])


@query(f"WITH RECURSIVE {_BEST} SELECT t, md5(d.text) AS restored_md5 FROM best JOIN documents d ON d.doc_id = best.t")
def vcdiff_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte deltas written, read again and applied to their bases."""
    foldwise.ship(spark)
    pairs = _pairs_with_text(spark, sf_dir)
    packed = frozen(pairs.select("t", "b", _byte_delta("base", "target").alias("packed")), "deltas")
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("b"), F.col("text").alias("base"))
    return packed.join(docs, "b").select("t", F.md5(_byte_restored("base", "packed")).alias("restored_md5"))


@query(f"""WITH RECURSIVE {_BEST} SELECT u.t, l.b AS root, md5(d.text) AS restored_md5 FROM best u JOIN best l ON l.t = u.b JOIN documents d ON d.doc_id = u.t""")
def vcdiff_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose base is a target itself, restored from the base's base by one composed delta."""
    foldwise.ship(spark)
    packed = frozen(_pairs_with_text(spark, sf_dir).select("t", "b", _byte_delta("base", "target").alias("packed")), "deltas")
    lower = packed.select(F.col("t").alias("b"), F.col("b").alias("root"), F.col("packed").alias("first"))
    both = packed.join(lower, "b").select("t", "root", _byte_composed("first", "packed").alias("packed"))
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("root"), F.col("text").alias("base"))
    return both.join(docs, "root").select("t", "root", F.md5(_byte_restored("base", "packed")).alias("restored_md5"))


@query()
def vcdiff_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    foldwise.ship(spark)
    return _pairs_with_text(spark, sf_dir).select("t", "b", F.length(_byte_delta("base", "target")).cast("long").alias("bytes"))


@query("SELECT doc_id, strlen(text)::BIGINT AS raw, md5(text) AS decoded_md5 FROM documents WHERE text IS NOT NULL")
def entropy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text entropy-coded, and decoded again."""
    foldwise.ship(spark)

    @pandas_udf("struct<data:binary,coded:boolean>")
    def code(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codecs.entropy_code(t.encode()) for t in texts], columns=["data", "coded"])

    @pandas_udf("string")
    def decode(data: pd.Series, coded: pd.Series) -> pd.Series:
        return pd.Series([codecs.entropy_decode(bytes(d), bool(c)).decode() for d, c in zip(data, coded, strict=True)])

    packed = frozen(_docs(spark, sf_dir).where("text is not null").select("doc_id", F.octet_length("text").cast("long").alias("raw"), code("text").alias("c")), "coded")
    return packed.select("doc_id", "raw", F.md5(decode("c.data", "c.coded")).alias("decoded_md5"))


_TURNS = "SELECT conv_id AS id, role AS plane, turn AS y, unnest(range(0, len(string_split(text, ' ')))) AS x, unnest(string_split(text, ' ')) AS block FROM conversations"


@query(f"SELECT id, count(*) AS blocks, sum((plane = 'user')::INT)::BIGINT AS user_blocks, sum((plane = 'assistant')::INT)::BIGINT AS assistant_blocks, sum(x * (y + 1))::BIGINT AS checksum FROM ({_TURNS}) GROUP BY id")
def plane_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = records.turns(records.table(spark, sf_dir, "conversations"))
    planes = [every.where(F.col("plane") == p) for p in ("user", "assistant")] + [every.where(~F.coalesce(F.col("plane").isin("user", "assistant"), F.lit(False)))]
    union = planes[0].unionByName(planes[1]).unionByName(planes[2])
    count = lambda p: F.sum((F.col("plane") == p).cast("long"))
    return union.groupBy("id").agg(F.count("*").alias("blocks"), count("user").alias("user_blocks"), count("assistant").alias("assistant_blocks"), F.sum(F.col("x") * (F.col("y") + 1)).alias("checksum"))


_PARTS = "meta, header, x, y, len, inl, residual"
_SIZES = f"""{_FIXED}, sizes AS (
  SELECT r.t, any_value(54 + length(best.t::VARCHAR) + length(best.b::VARCHAR) + 2) AS meta, any_value(CASE WHEN string_split(dt.text, chr(10))[1] = string_split(db.text, chr(10))[1] THEN 0 ELSE strlen(string_split(dt.text, chr(10))[1]) END) AS header,
    2 * sum((op = 'COPY')::INT) AS x, 2 * sum((op = 'COPY')::INT) AS y, 2 * sum((op = 'COPY')::INT) AS len, 2 * count(*) AS inl,
    coalesce(any_value(q.n), 0) AS residual FROM runs r JOIN best ON best.t = r.t JOIN documents dt ON dt.doc_id = best.t JOIN documents db ON db.doc_id = best.b
    LEFT JOIN (SELECT m.t, sum(strlen(c.block))::BIGINT AS n FROM marked m JOIN cells c ON c.id = m.t AND c.y = m.y AND c.x = m.x WHERE m.op = 'INSERT' GROUP BY m.t) q ON q.t = r.t GROUP BY r.t
)"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each target's delta record: names and sizes, the first line unless it is the base's, two for each instruction field, and the residual words."""
    first = lambda c: F.element_at(records.lines(F.col(c)), 1)
    meta = F.lit(56) + F.length(F.col("t").cast("string")) + F.length(F.col("b").cast("string"))
    header = F.when(first("target") == first("base"), 0).otherwise(F.octet_length(first("target")))
    opens = delta.opened(delta.marked(_pairs_with_text(spark, sf_dir).withColumns({"meta": meta, "header": header}), "meta", "header"))
    copies = F.sum(F.when(F.col("copy"), F.col("opens")).otherwise(0))
    return opens.groupBy("t").agg(
        F.max("meta").cast("long").alias("meta"), F.max("header").cast("long").alias("header"), (2 * copies).alias("x"), (2 * copies).alias("y"), (2 * copies).alias("len"),
        (2 * F.sum("opens")).alias("inl"), F.sum(F.when(~F.col("copy"), F.col("bytes")).otherwise(0)).alias("residual"),
    )


@query(f"WITH RECURSIVE {_SIZES} SELECT t, meta::BIGINT AS meta, header::BIGINT AS header, x::BIGINT AS x, y::BIGINT AS y, len::BIGINT AS len, inl::BIGINT AS inl, residual::BIGINT AS residual FROM sizes")
def delta_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir)


@query(f"""WITH RECURSIVE {_SIZES}, s AS (SELECT {", ".join(f"sum({c}) AS {c}" for c in _PARTS.split(", "))}, sum({_PARTS.replace(", ", " + ")}) AS total FROM sizes), u AS (UNPIVOT s ON {_PARTS}, total INTO NAME part VALUE bytes)
SELECT part, bytes::BIGINT AS bytes, round(bytes::DOUBLE / max(CASE WHEN part = 'total' THEN bytes END) OVER (), 6) AS share FROM u""")
def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.breakdown(_sizes(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SIZES}, r AS (
  SELECT doc_id, strlen(text) AS raw, 4 * length(text) AS decoded, 4 * length(string_split(text, chr(10))[1]) AS detected, length(text) >= 64 AND text LIKE '%.' AS valid, s.t IS NOT NULL AND length(text) >= 64 AND text LIKE '%.' AS found,
    coalesce(meta + header + x + y + len + inl + s.residual, 0) AS delta, coalesce(s.residual, 0) AS residual
  FROM documents LEFT JOIN sizes s ON s.t = doc_id
), f AS (SELECT *, found AND delta <= raw AS matched, found AND delta > raw AS omitted FROM r
), a AS (
  SELECT sum(raw)::BIGINT AS raw_bytes, coalesce(sum(raw) FILTER (NOT valid), 0)::BIGINT AS undecodable_bytes, coalesce(sum(CASE WHEN matched THEN delta ELSE raw END) FILTER (valid), 0)::BIGINT AS final_bytes, coalesce(sum(raw) FILTER (valid AND NOT found), 0)::BIGINT AS unmatched_bytes,
    coalesce(sum(raw) FILTER (found), 0)::BIGINT AS delta_raw_bytes, coalesce(sum(decoded) FILTER (valid), 0)::BIGINT AS decoded_bytes, coalesce(sum(detected) FILTER (valid), 0)::BIGINT AS detected_bytes, coalesce(sum(decoded) FILTER (found), 0)::BIGINT AS delta_decoded_bytes,
    coalesce(sum(raw) FILTER (omitted), 0)::BIGINT AS omitted_bytes, coalesce(sum(residual) FILTER (matched), 0)::BIGINT AS residual_bytes FROM f
) SELECT *, round((raw_bytes - undecodable_bytes)::DOUBLE / final_bytes, 6) AS compression_ratio, round((raw_bytes - undecodable_bytes - unmatched_bytes)::DOUBLE / (final_bytes - unmatched_bytes), 6) AS similar_ratio,
  round(1 - round(unmatched_bytes::DOUBLE / (raw_bytes - undecodable_bytes), 6), 6) AS success_rate, round(decoded_bytes::DOUBLE / (raw_bytes - undecodable_bytes), 6) AS expansion,
  round(decoded_bytes::DOUBLE / detected_bytes, 6) AS detected_ratio, round(decoded_bytes::DOUBLE / delta_decoded_bytes, 6) AS delta_ratio, round(omitted_bytes::DOUBLE / delta_raw_bytes, 6) AS omitted_ratio FROM a""")
def compression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and ratios of all texts: decoded is four bytes a character, detected that of the first line; deltas longer than their text are omitted."""
    parts = sum((F.col(c) for c in ("header", "x", "y", "len", "inl", "residual")), F.col("meta"))
    sizes = _sizes(spark, sf_dir).select(F.col("t").alias("doc_id"), parts.alias("delta"), "residual")
    docs = _docs(spark, sf_dir).join(sizes, "doc_id", "left")
    raw, valid = F.octet_length("text"), records.valid(F.col("text"))
    first = F.element_at(records.lines(F.col("text")), 1)
    rows = docs.select(
        raw.alias("raw"), valid.alias("valid"), (F.col("delta").isNotNull() & valid).alias("found"), "delta", (4 * F.length("text")).alias("decoded"), (4 * F.length(first)).alias("detected"),
        F.coalesce("residual", F.lit(0)).alias("residual"),
    )
    return stats.compression_metrics(rows)


@query(f"""WITH RECURSIVE {_BEST}, {_COPIED} SELECT least(19, floor(copied * 20 / cells))::INT AS bin, count(*) AS targets FROM copied GROUP BY 1""")
def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of blocks that the instructions copy: from anywhere in the base, or from the same place if the pair is matched by position."""
    pairs = _pairs_with_text(spark, sf_dir)
    moved = delta.matched_cells(pairs.where("fix_flag = 1"))
    still = delta.marked(pairs.where("fix_flag = 0")).groupBy("t").agg(F.count("*").alias("cells"), F.sum(F.col("copy").cast("long")).alias("matched"))
    return stats.similarity_histogram(moved.unionByName(still))


@query(f"WITH {_SLOTS}, g AS (SELECT count(*) AS n FROM slots GROUP BY k, sf) SELECT sum(n - 1)::BIGINT AS hits, sum(n)::BIGINT AS slots, round(sum(n - 1)::DOUBLE / sum(n), 6) AS rate FROM g")
def collision_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.collision_rate(_slots(spark, sf_dir))


_BYTES = "SELECT byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents) GROUP BY byte"


@query(_BYTES)
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.byte_histogram(_docs(spark, sf_dir))


_ROUND_UP = ", ".join(map(str, tans.ROUND_UP))


@query(f"""WITH h AS ({_BYTES}), t AS (SELECT sum(n)::BIGINT AS total FROM h), s AS (
  SELECT byte, n, total, n * (4611686018427387904 // total) AS part, (n * (4611686018427387904 // total)) >> 51 AS share FROM h, t
), r AS (
  SELECT byte, n, total, CASE WHEN n <= total >> 11 THEN -1 ELSE share + (share < 8 AND part - (share << 51) > [{_ROUND_UP}][least(share, 7) + 1]::BIGINT << 31)::INT END AS freq FROM s
) SELECT byte, (freq + CASE WHEN row_number() OVER (ORDER BY freq DESC, byte) = 1 THEN 2048 - sum(abs(freq)) OVER () ELSE 0 END)::BIGINT AS freq FROM r""")
def normalized_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.normalised(stats.byte_histogram(_docs(spark, sf_dir)))


_ZZ = f"[{', '.join(str(i + 1) for i in codecs.ZIGZAG)}]"
_ZIG = f"{_BLOCKS}, z AS (SELECT vec_id, list_transform({_ZZ}, lambda i: c[i]) AS z FROM blocks)"


@query(f"WITH {_ZIG} SELECT vec_id, array_to_string(z, ' ') AS z FROM z")
def zigzag_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.blocks(records.table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", F.array_join(codecs.zigzag_column(F.col("c")).cast("array<string>"), " ").alias("z"))


_UNZZ = f"[{', '.join(str(codecs.ZIGZAG.index(i) + 1) for i in range(64))}]"


@query(f"WITH {_BLOCKS} SELECT vec_id, array_to_string(list_transform({_UNZZ}, lambda i: c[i]), ' ') AS c FROM blocks")
def dezigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks read as zigzag sequences, in natural order."""
    rows = records.blocks(records.table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", F.array_join(codecs.dezigzag_column(F.col("c")).cast("array<string>"), " ").alias("c"))


def _first_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.blocks(records.table(spark, sf_dir, "embeddings")).select("vec_id", F.get("c", 0).cast("long").alias("dc"))


@query(f"WITH {_BLOCKS} SELECT vec_id, c[1]::BIGINT - lag(c[1], 1, 0) OVER (ORDER BY vec_id) AS diff FROM blocks")
def dpcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First coefficients as differences to the block before, over all blocks."""
    rows = ordered.with_neighbour(_first_coefficients(spark, sf_dir), ["vec_id"], "dc", "previous", before=True)
    return rows.select("vec_id", (F.col("dc") - F.coalesce("previous", F.lit(0))).alias("diff"))


@query(f"WITH {_BLOCKS} SELECT vec_id, sum(c[1]) OVER (ORDER BY vec_id)::BIGINT AS dc FROM blocks")
def inverse_dpcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First coefficients read as differences: their running sums over all blocks."""
    return ordered.running_sum(_first_coefficients(spark, sf_dir), ["vec_id"], "dc", "sum").select("vec_id", F.col("sum").alias("dc"))


_COEF = f"{_ZIG}, e AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(z) AS v FROM z)"


@query(f"""WITH {_COEF}, n AS (SELECT vec_id, i, v, i - 1 - coalesce(lag(i) OVER (PARTITION BY vec_id ORDER BY i), -1) AS gap FROM e WHERE v <> 0)
SELECT vec_id, i, gap % 16 AS run, v FROM n
UNION ALL SELECT vec_id, i - gap % 16 - 1 - 16 * (unnest(range(0, gap // 16))) AS i, 15 AS run, 0 AS v FROM n
UNION ALL SELECT vec_id, 64 AS i, 0 AS run, 0 AS v FROM (SELECT DISTINCT vec_id FROM e) WHERE vec_id NOT IN (SELECT vec_id FROM n WHERE i = 63)""")
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, value) pairs in zigzag order, i is where a pair ends: sixteen zeros are (15, 0), zeros up to the end (0, 0) at 64."""
    rows = records.blocks(records.table(spark, sf_dir, "embeddings")).select("vec_id", codecs.zigzag_column(F.col("c")).alias("z"))
    places = F.filter(F.transform("z", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda x: x["v"] != 0)

    def of(found):
        def pairs(x, k):
            before = F.when(k > 0, F.get(found, k - 1)["i"]).otherwise(-1)
            gap = x["i"] - before - 1
            full = F.floor(gap / 16).cast("int")
            escapes = F.transform(F.when(full > 0, F.sequence(F.lit(1), full)).otherwise(F.expr("cast(array() as array<int>)")), lambda j: F.struct((before + 16 * j).alias("i"), F.lit(15).alias("run"), F.lit(0).alias("v")))
            return F.concat(escapes, F.array(F.struct(x["i"].alias("i"), (gap % 16).alias("run"), x["v"].alias("v"))))

        end = F.when(F.coalesce(F.element_at(F.transform(found, lambda x: x["i"]), -1), F.lit(-1)) == 63, F.expr("cast(array() as array<struct<i:int,run:int,v:int>>)")).otherwise(F.array(F.struct(F.lit(64).alias("i"), F.lit(0).alias("run"), F.lit(0).alias("v"))))
        return F.concat(F.flatten(F.transform(found, pairs)), end)

    return rows.select("vec_id", F.explode(records.let(places, of)).alias("p")).select("vec_id", "p.i", "p.run", "p.v")


@query(f"WITH {_COEF} SELECT vec_id, sum(CASE WHEN v = 0 THEN 0 ELSE length(bin(abs(v))) END)::BIGINT AS bits, sum((v <> 0)::INT)::BIGINT AS symbols FROM e GROUP BY vec_id")
def vli_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.blocks(records.table(spark, sf_dir, "embeddings"))
    zero = F.lit(0).cast("long")
    bits = F.aggregate("c", zero, lambda s, v: s + codecs.bit_length_column(v))
    return rows.select("vec_id", bits.alias("bits"), F.aggregate("c", zero, lambda s, v: s + (v != 0).cast("long")).alias("symbols"))


@query(f"WITH {_BLOCKS}, e AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(c) AS v FROM blocks) SELECT vec_id // 64 AS part, count(DISTINCT vec_id) AS blocks, sum(i * v * (vec_id % 64 + 1))::BIGINT AS checksum FROM e GROUP BY 1")
def residual_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of 64 blocks packed into a residual container, written, and read back; the checksum is that of the blocks read."""
    foldwise.ship(spark)

    def pack(key, rows):
        rows = rows.sort_values("vec_id")
        return pd.DataFrame([(key[0], rows["vec_id"].to_list(), codecs.pack_residual(np.stack(rows["c"].to_list())))], columns=["part", "ids", "data"])

    @pandas_udf("long")
    def checksum(ids: pd.Series, data: pd.Series) -> pd.Series:
        weights = [(np.asarray(i) % 64 + 1)[:, None] * np.arange(1, 65) for i in ids]
        return pd.Series([int((codecs.unpack_residual(bytes(d)) * w).sum()) for d, w in zip(data, weights, strict=True)])

    rows = records.blocks(records.table(spark, sf_dir, "embeddings")).withColumn("part", F.floor(F.col("vec_id") / 64))
    packed = frozen(rows.groupBy("part").applyInPandas(pack, "part long, ids array<long>, data binary"), "residuals")
    return packed.select("part", F.size("ids").cast("long").alias("blocks"), checksum("ids", "data").alias("checksum"))


@query(f"WITH RECURSIVE {_FIXED} SELECT t, count(*) AS runs, sum(x)::BIGINT AS sum_x, sum(len)::BIGINT AS sum_len FROM runs GROUP BY t")
def instruction_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of each target's instructions, coded where that is smaller, and read back."""
    foldwise.ship(spark)

    @pandas_udf("struct<runs:long,sum_x:long,sum_len:long>")
    def back(x: pd.Series, length: pd.Series) -> pd.DataFrame:
        read = [[codecs.unpack_column(*codecs.pack_column(list(v))) for v in column] for column in (x, length)]
        return pd.DataFrame({"runs": [len(v) for v in read[0]], "sum_x": [sum(v) for v in read[0]], "sum_len": [sum(v) for v in read[1]]})

    runs = delta.fixed_point(_pairs_with_text(spark, sf_dir)).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("y", "x", "len"))).alias("r"))
    return runs.select("t", back(F.col("r.x"), F.col("r.len")).alias("b")).select("t", "b.*")


# ---- images: every text as a baseline JPEG ----

#: Bytes of a batch of images in the registered queries.
IMAGE_BATCH = 2_000_000
#: Blocks of first planes that are sketched together.
SKETCHED = 1 << 18


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    foldwise.ship(spark)
    # rendering a text costs far more than moving it, and a small table is one partition
    return _docs(spark, sf_dir).select("doc_id", "source", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frozen(rendered.images(_documents(spark, sf_dir)), "images")


def _image_id():
    return F.regexp_extract("path", r"([0-9-]+)\.jpg$", 1).cast("long")


def _image_facts(files: DataFrame) -> DataFrame:
    """What the coefficients of each decodable file say: its size in pixels, the sum of first coefficients, how many are not zero, and whether encoding them gives the file again."""

    @pandas_udf("struct<width:int,height:int,dc_sum:long,nonzero:long,same:boolean>")
    def facts(contents: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None, None, None)] * len(contents)
        for i, own in jpeg.decoded(contents):
            try:
                if own is not None:
                    luma = own.planes[0]
                    rows[i] = (8 * luma.shape[1], 8 * luma.shape[0], int(luma[:, :, 0].sum(dtype="int64")), sum(int(np.count_nonzero(p)) for p in own.planes), jpeg.encode(own) == bytes(contents.iloc[i]))
            except jpeg.UNREADABLE:
                continue
        return pd.DataFrame(rows, columns=["width", "height", "dc_sum", "nonzero", "same"])

    return files.select(_image_id().alias("doc_id"), facts("content").alias("f")).select("doc_id", "f.*")


_HEX = " + ".join(f"(('0x' || substr(m, {2 * i + 1}, 2))::BIGINT // 32 <> 4)::BIGINT" for i in range(1, rendered.COEFFICIENTS))
_FACTS = f"""{_CELLS}, digests AS (SELECT id, md5(block) AS m FROM cells), facts AS (
  SELECT id, {8 * rendered.COLUMNS} AS width, 8 * greatest({rendered.LEAST_ROWS}, (count(*) + {rendered.COLUMNS - 1}) // {rendered.COLUMNS})::INT AS height,
    sum(('0x' || substr(m, 1, 2))::BIGINT - 128)::BIGINT AS dc_sum, sum((('0x' || substr(m, 1, 2))::BIGINT <> 128)::BIGINT + {_HEX})::BIGINT AS nonzero FROM digests GROUP BY id
)"""


@query(f"WITH {_FACTS} SELECT doc_id, width, height, dc_sum, nonzero, CASE WHEN width IS NOT NULL THEN true END AS same FROM documents LEFT JOIN facts ON id = doc_id")
def image_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files decoded to coefficients and encoded again with their own tables."""
    return _image_facts(_images(spark, sf_dir))


@query("SELECT doc_id, strlen(text) AS text_bytes FROM documents WHERE text IS NULL")
def image_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be decoded."""

    @pandas_udf("boolean")
    def damaged(contents: pd.Series) -> pd.Series:
        out = []
        for data in contents:
            try:
                jpeg.decode(bytes(data))
                out.append(False)
            except (Damaged, IndexError, KeyError, ValueError):
                out.append(True)
        return pd.Series(out, dtype=bool)

    found = _images(spark, sf_dir).where(damaged("content")).select(_image_id().alias("doc_id"))
    return _docs(spark, sf_dir).join(found, "doc_id").select("doc_id", F.octet_length("text").cast("long").alias("text_bytes"))


def _image_archive(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    config = DedupConfig(chunking="f", patch_size=IMAGE_BATCH, **options)
    files = _images(spark, sf_dir)
    numbers = archive.numbered(files, config)
    return files.select("path", "length").join(numbers, "path"), *archive.compress(files, config, numbers=numbers)


@query(f"WITH {_FACTS} SELECT doc_id, width, height, dc_sum, nonzero, CASE WHEN width IS NOT NULL THEN true END AS same FROM documents LEFT JOIN facts ON id = doc_id")
def image_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files say after compression to block records and restoration."""
    _, packed, originals = _image_archive(spark, sf_dir)
    return _image_facts(archive.restore(packed, originals))


@query(f"WITH {_FACTS} SELECT doc_id, width, height, dc_sum, nonzero, CASE WHEN width IS NOT NULL THEN true END AS same FROM documents LEFT JOIN facts ON id = doc_id")
def image_restore_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with byte records of the coefficients, chains composed before they are applied."""
    _, packed, originals = _image_archive(spark, sf_dir, delta="bytes")
    return _image_facts(archive.restore(archive.composed(packed), originals))


@query()
def image_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first super-feature of each file by every method: feature maps of both dimensions, Rabin over squares, bytes and blocks, gear over bytes and blocks."""
    methods = [("2df", 2, 2), ("2df", 1, 2), ("rabin", 2, 2), ("rabin", 1, 16), ("rabin", 3, 2), ("gear", 1, 2), ("gear", 3, 2)]
    configs = [DedupConfig(feature_method=m, dimension=d, block_size=b) for m, d, b in methods]

    def run(batches):
        yield from firsts(rendered.files(batches))

    def firsts(files):
        held, paths, blocks = [], {}, 0

        def contents():
            for batch in files:
                for path, content in zip(batch["path"], batch["content"], strict=True):
                    paths[len(paths)] = path, content
                    yield content

        def found():
            sketches = sketch.first_super_features([([plane], data) for _, plane, data in held], configs)
            return pd.DataFrame({"path": [path for path, *_ in held], "sf": sketches})

        for i, image in jpeg.decoded(contents(), planes=1):
            path, data = paths[i]
            paths[i] = None
            if image is None:
                yield pd.DataFrame({"path": [path], "sf": [None]})
                continue
            held.append((path, image.planes[0], data))
            blocks += held[-1][1].size // 64
            if blocks >= SKETCHED:
                yield found()
                held, blocks = [], 0
        if held:
            yield found()

    # each file is read once, by the process that makes it
    made = _documents(spark, sf_dir).mapInPandas(run, "path string, sf array<long>")
    return made.select("path", *[F.get("sf", i).alias(f"{m}{d}") for i, (m, d, _) in enumerate(methods)])


@query()
def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compression report's numbers, batch by batch and in total."""
    return archive.metrics(*_image_archive(spark, sf_dir))


@query(f"WITH RECURSIVE {_BEST}, c AS (SELECT t, b AS root, 1 AS depth FROM best UNION ALL SELECT c.t, best.b, c.depth + 1 FROM c JOIN best ON best.t = c.root) SELECT t, arg_max(root, depth) AS root, max(depth) AS depth FROM c GROUP BY t")
def chain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.chain_depth(_best(spark, sf_dir), frozen)


@query("SELECT floor(epoch(ts) / 3600)::BIGINT AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.table(spark, sf_dir, "events")
    return rows.groupBy(F.floor(F.unix_timestamp("ts") / 3600).alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query()
def lru_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer of its own for each batch of 1000 requests, as a batch's buffer goes with the batch."""
    foldwise.ship(spark)
    rows = records.table(spark, sf_dir, "events")
    trace = rows.select(F.floor(F.col("event_id") / 1000).alias("shard"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"), (F.length("props") + 1).cast("long").alias("size"), F.lit(2).alias("pins"))
    return stats.lru(trace, 400)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all.items() if sql}
