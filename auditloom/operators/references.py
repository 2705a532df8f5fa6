"""References to records that do not exist.

Keys become integers: a key's range is taken from its hash and its position from its order
within the range. Per range and period the referenced positions form one bitmap of 4 KB, and so do
the defined ones per range; reference AND-NOT parent leaves the orphans, which are decoded and joined
back to the rows that hold them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.session import materialise, ship

#: Bits of one bitmap, as bitmap_construct_agg makes them.
BITMAP_BITS = 32_768
#: Keys meant for one range; hashing spreads them so evenly that no range comes near BITMAP_BITS.
RANGE_KEYS = 16_384
#: Linking rows of a key and month from which they are split for the last join, into shares of this size; a key may hold a third of all rows.
SALT_ROWS = 100_000
#: Hot keys that are broadcast; more of them are joined without a hint.
HOT_KEYS = 100_000
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host without user and port; empty if the URL names none."""
    authority = F.regexp_extract(url, _URL, 2)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def url_key(url: Column) -> Column:
    """The URL without fragment and with scheme and host in lower case; other text only loses the fragment."""
    whole = F.concat(F.lower(F.regexp_extract(url, _URL, 1)), F.lit("://"), F.lower(F.regexp_extract(url, _URL, 2)), F.regexp_extract(url, _URL, 3))
    return F.when(F.regexp_extract(url, _URL, 1) != "", whole).otherwise(F.regexp_replace(url, "#.*$", ""))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _bits_and_not(ref: pd.Series, parent: pd.Series) -> pd.Series:
    """Positions set in the first bitmap and not in the second."""
    import numpy as np

    out = []
    for a, b in zip(ref, parent):
        x = np.frombuffer(a, np.uint8)
        if b is not None:
            x = x & ~np.frombuffer(b, np.uint8)
        out.append(np.flatnonzero(np.unpackbits(x, bitorder="little")).astype("int32"))
    return pd.Series(out)


def _bitmap(c: Column) -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position(c))


def orphan_references(pages: DataFrame, late_after: str = "24 hours") -> DataFrame:
    """``(seq, link, kind, site, month)``: links to the page's own site without a proper target.

    ``missing``: no row has the URL; else ``deleted``: its row fetched last has status 404 or 410
    (of equal times the highest ``seq``); else ``late``: all its rows were fetched more than
    ``late_after`` after the linking row. Rows without links, site or URL link or define nothing;
    without a fetch time a row cannot be late. A link that a page repeats counts once. An empty table
    gives an empty result.
    """
    ship(pages.sparkSession)
    links = (
        pages.where(F.col("links").isNotNull() & F.col("site").isNotNull())
        .select("seq", "site", "fetched_at", F.explode(F.array_distinct("links")).alias("link"))
        .where(F.col("link").isNotNull())
        .where(url_host(F.col("link")) == F.lower("site"))
        .withColumn("key", url_key(F.col("link")))
        .withColumn("month", F.date_format("fetched_at", "yyyy-MM"))
    )
    used = links.groupBy("key", "month").agg(F.count("*").alias("n"))
    defined = (
        pages.where(F.col("url").isNotNull())
        .select(url_key(F.col("url")).alias("key"), "fetched_at", "seq", "status_code")
        .groupBy("key")
        .agg(
            F.min("fetched_at").alias("first_at"),
            F.max(F.struct("fetched_at", "seq", "status_code")).alias("m"),
        )
        .select("key", "first_at", F.col("m.status_code").isin(404, 410).alias("deleted"))
    )
    keys = materialise(
        used.select("key", "month", F.lit(None).cast("timestamp").alias("first_at"), F.lit(None).cast("boolean").alias("deleted"), F.lit(0).alias("side"), "n")
        .unionByName(defined.select("key", F.lit(None).cast("string").alias("month"), "first_at", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("n")))
    )
    ranges = max(1, -(-keys.count() // RANGE_KEYS))
    coded = materialise(
        keys.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
        .withColumn("pos", F.dense_rank().over(Window.partitionBy("range").orderBy("key")) - 1)
        .withColumn("part", F.floor(F.col("pos") / BITMAP_BITS).cast("int"))
        .withColumn("bit", (F.col("pos") % BITMAP_BITS + 1).cast("long"))
    )
    ref_maps = coded.where("side = 0").groupBy("range", "part", "month").agg(_bitmap(F.col("bit")).alias("refs"))
    parents = coded.where("side = 1")
    own = parents.groupBy("range", "part").agg(_bitmap(F.col("bit")).alias("any"))
    gone = parents.where("deleted").groupBy("range", "part").agg(_bitmap(F.col("bit")).alias("bits"))
    lasting = parents.where(~F.col("deleted")).groupBy("range", "part").agg(_bitmap(F.col("bit")).alias("bits"))
    first = parents.where("first_at IS NOT NULL").groupBy("range", "part", F.date_format("first_at", "yyyy-MM").alias("since")).agg(_bitmap(F.col("bit")).alias("bits"))
    on = ["range", "part"]
    # months before the linking one: a target seen there cannot be late
    before = (
        ref_maps.join(first, on)
        .where("since < month")
        .groupBy(*on, "month")
        .agg(F.bitmap_or_agg("bits").alias("arrived"))
    )
    maps = ref_maps.join(own, on, "left").join(gone, on, "left").withColumnRenamed("bits", "gone").join(lasting, on, "left").withColumnRenamed("bits", "lasting")
    maps = maps.alias("a").join(before.alias("b"), (F.col("a.range") == F.col("b.range")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.month") == F.col("b.month")), "left").select("a.*", "b.arrived")
    empty = F.lit(bytes(BITMAP_BITS // 8))
    hits = maps.select(
        "range", "part", "month",
        F.explode(
            F.array(
                F.struct(F.lit("missing").alias("kind"), _bits_and_not("refs", "any").alias("bits")),
                # what is referenced, and neither undefined nor lasting, is deleted
                F.struct(F.lit("deleted").alias("kind"), _bits_and_not("refs", _bitmap_not("gone")).alias("bits")),
                F.struct(F.lit("late").alias("kind"), _bits_and_not(_bits_and("refs", F.coalesce("lasting", empty)), "arrived").alias("bits")),
            )
        ).alias("h"),
    ).select("range", "part", "month", "h.kind", F.explode("h.bits").alias("at"))
    decoded = (
        coded.where("side = 0").select("range", "part", "month", F.col("bit").cast("int").alias("at1"), "key")
        .withColumn("at", F.col("at1") - 1)
        .alias("k")
        .join(hits.alias("h"), (F.col("k.range") == F.col("h.range")) & (F.col("k.part") == F.col("h.part")) & (F.col("k.at") == F.col("h.at")) & F.col("k.month").eqNullSafe(F.col("h.month")))
        .select("k.key", F.col("k.month").alias("month"), "h.kind")
    )
    # late ones are decided by the exact times of the few targets that are left
    timed = decoded.alias("d").join(
        parents.select("key", "first_at").alias("p"), (F.col("d.key") == F.col("p.key")) & (F.col("d.kind") == "late"), "left"
    ).select("d.key", "d.month", "d.kind", "p.first_at")
    hot = materialise(keys.where(F.col("n") > SALT_ROWS).select("key", "month", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")))
    n_hot = hot.count()
    if n_hot:
        small = F.broadcast(hot) if n_hot <= HOT_KEYS else hot  # a checked size
        links, timed = _salted(links, small), _salted(timed, small).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        links = links.withColumn("salt", F.pmod(F.xxhash64("seq"), F.col("salts")).cast("int"))
    else:
        links, timed = links.withColumn("salt", F.lit(0)), timed.withColumn("salt", F.lit(0))
    l, t = links.alias("l"), timed.alias("t")
    out = l.join(t, (F.col("l.key") == F.col("t.key")) & (F.col("l.salt") == F.col("t.salt")) & F.col("l.month").eqNullSafe(F.col("t.month")))
    late = F.coalesce(F.col("t.first_at") > F.col("l.fetched_at") + F.expr(f"INTERVAL {late_after}"), F.lit(False))
    return out.where((F.col("t.kind") != "late") | late).select("l.seq", "l.link", "t.kind", "l.site", "l.month")


def _salted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows with ``salts``, the number of shares of their key and month."""
    r, h = rows.alias("r"), hot.alias("h")
    joined = r.join(h, (F.col("r.key") == F.col("h.key")) & F.col("r.month").eqNullSafe(F.col("h.month")), "left")
    return joined.select("r.*", F.coalesce(F.col("h.salts"), F.lit(1)).alias("salts"))


@F.pandas_udf(T.BinaryType())
def _bits_and(a: pd.Series, b: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series([(np.frombuffer(x, np.uint8) & np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(a, b)])


@F.pandas_udf(T.BinaryType())
def _bitmap_not(a: pd.Series) -> pd.Series:
    import numpy as np

    full = b"\xff" * (BITMAP_BITS // 8)
    return pd.Series([full if x is None else (~np.frombuffer(x, np.uint8)).tobytes() for x in a])


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references counted per site, month and kind."""
    return orphans.groupBy("site", "month", "kind").agg(F.count("*").alias("n_links"), F.countDistinct("seq").alias("n_pages"))
