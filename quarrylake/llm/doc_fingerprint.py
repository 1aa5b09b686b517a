"""Canonical exact fingerprints, with DataFrame functions only.

The canonical form is NFKC, full case folding, NFKC again and white-space folding (ICU's static
methods through Spark SQL's ``reflect``; pure ASCII takes ``lower``).  Texts are grouped by a 128-bit
xxhash of that form; inside equal buckets every member is compared with the bucket's representative,
byte for byte, and a member that differs gets a fingerprint of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import NO_ID, checkpointed, id_in, shuffle_width

#: Rows of one range partition when the order of the ids is worked out.
RANGE_ROWS = 500_000
#: Ids that may be broadcast; a larger set is joined by shuffling.
BROADCAST_IDS = 500_000


def canonical(text: Column) -> Column:
    """NFKC, case and white-space folding."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(nfkc(fold(nfkc(text))))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}]+", " "))


def wide_hash(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit halves: the second starts from another seed."""
    return F.xxhash64(text), F.xxhash64(F.lit("wide"), text)


def hex128(h1: Column, h2: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(h1)), 16, "0"), F.lpad(F.lower(F.hex(h2)), 16, "0"))


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``: on the map side if the set is small, else by a shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def differing(members: DataFrame) -> DataFrame:
    """Members (key, kind, h1, h2, canon, is_rep, salts) whose bytes are not those of their bucket's representative.

    The representative is copied to as many salts as its bucket needs, so a hot bucket is spread out.
    """
    reps = members.filter("is_rep").select("h1", "h2", F.col("canon").alias("rep_canon"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rest = members.filter("not is_rep").withColumn("salt", F.pmod(F.xxhash64("key", "kind"), F.col("salts")).cast("int"))
    return rest.join(reps, ["h1", "h2", "salt"]).filter(F.col("canon") != F.col("rep_canon")).select("key", "kind", F.sha2("canon", 256).alias("own"))


def bucket_members(hashed: DataFrame, per_salt: int = 2000) -> DataFrame:
    """(key, kind, h1, h2, is_rep, salts) of the hashes that more than one text has."""
    buckets = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("key", "kind")).alias("rep")).filter("n > 1")
    large = buckets.filter(F.col("n") > per_salt * 50)
    small = buckets.filter(F.col("n") <= per_salt * 50)
    is_rep = (F.col("key") == F.col("rep.key")) & (F.col("kind") == F.col("rep.kind"))
    pick = lambda b: hashed.join(b, ["h1", "h2"]).select("key", "kind", "h1", "h2", is_rep.alias("is_rep"), F.ceil(F.col("n") / per_salt).cast("int").alias("salts"))
    total = hashed.count()
    return pick(F.broadcast(large) if total // (per_salt * 50) < BROADCAST_IDS else large).unionByName(pick(small))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text): rows with a key of their own.

    The key is the id, null as NO_ID.  Where an id comes more than once, keys are (id, hash of the text, row
    number), so rows with one id are in the order of that hash; equal rows are in any order.
    """
    docs = df.select(id_in(id_col, "key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if docs.groupBy("key").count().filter("count > 1").isEmpty():
        return docs
    row = F.monotonically_increasing_id()  # of a stored table: it stays as it is
    return checkpointed(docs.select(F.struct(F.col("key").alias("id"), F.xxhash64("text").alias("text"), row.alias("row")).alias("key"), "text"))


def shown_id(docs: DataFrame, key: str = "key") -> Column:
    field = f"{key}.id" if isinstance(docs.schema[key].dataType, StructType) else key
    return F.nullif(field, F.lit(NO_ID)).alias("doc_id")


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row; ids may repeat.

    Null text counts as empty.  Equal canonical forms have equal fingerprints; forms that collide on
    all 128 bits are told apart by a byte comparison.  An empty table gives no rows.
    """
    docs = keyed(df, id_col, text_col)
    h1, h2 = wide_hash(canonical(F.col("text")))
    hashed = checkpointed(docs.select("key", F.lit(0).alias("kind"), h1.alias("h1"), h2.alias("h2")))
    members = checkpointed(bucket_members(hashed))
    texts = restrict(docs, members.select("key"), "key").select("key", canonical(F.col("text")).alias("canon"))
    odd = differing(members.join(texts, "key")).select("key", "own")
    out = hashed.join(odd, "key", "left")
    shown = F.concat(hex128(F.col("h1"), F.col("h2")), F.coalesce(F.concat(F.lit(":"), "own"), F.lit("")))
    return out.select(shown_id(out), shown.alias("fingerprint"))


def successors(keys: DataFrame, rows: int) -> DataFrame:
    """(key, next_key, ...): the next key in descending order; after the last comes the first.

    Keys are dealt by range; inside a range a window finds the next one, and only one row per range
    takes part in the window over ranges.
    """
    width = max(shuffle_width(keys.sparkSession), -(-rows // RANGE_ROWS))
    dealt = checkpointed(keys.repartitionByRange(width, F.col("key").desc()).withColumn("range", F.spark_partition_id()))
    heads = dealt.groupBy("range").agg(F.max("key").alias("head"))
    order = Window.orderBy("range")
    after = F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("range", after.alias("after"))
    inside = F.lead("key").over(Window.partitionBy("range").orderBy(F.col("key").desc()))
    return dealt.withColumn("inside", inside).join(F.broadcast(heads), "range").select(*keys.columns, F.coalesce("inside", "after").alias("next_key"))


def edited_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, next_key, n_chars, text, edited): the last third replaced by the head of the next document."""
    pairs = pairs.withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    heads = docs.join(pairs.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), "cut"), "key")
    heads = heads.select(F.col("for_key").alias("key"), F.substring("text", F.lit(1), F.col("cut")).alias("head"))
    both = docs.join(heads, "key").join(pairs, "key")
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int"))
    return both.select("key", "next_key", "n_chars", "text", F.concat(kept, F.col("head")).alias("edited"))


def edit_sensitivity(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited forms, and whether they agree.

    One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.  An exact fingerprint's likeness is 1 where two are equal and else 0.  Null text counts
    as empty, a null id sorts below all others.  Rows that share an id are documents of their own, in
    descending order of a hash of their texts.  A single document is its own next one; an empty table
    gives no rows.
    """
    docs = keyed(df, id_col, text_col)
    keys = docs.select("key", F.length("text").cast("long").alias("n_chars"))
    pairs = checkpointed(successors(keys, keys.count()))

    def halves(col: str, name: str) -> list[Column]:
        h1, h2 = wide_hash(canonical(F.col(col)))
        return [h1.alias(f"{name}1"), h2.alias(f"{name}2")]

    both = edited_texts(docs, pairs)
    facts = checkpointed(both.select("key", "next_key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *halves("text", "t"), *halves("edited", "e")))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("t1").alias("h1"), F.col("t2").alias("h2")), F.struct(F.lit(1).alias("kind"), F.col("e1").alias("h1"), F.col("e2").alias("h2"))))
    hashed = facts.select("key", kinds.alias("x")).select("key", "x.*")
    members = checkpointed(bucket_members(hashed))
    plain = restrict(docs, members.filter("kind = 0").select("key").distinct(), "key").select("key", F.lit(0).alias("kind"), canonical(F.col("text")).alias("canon"))
    wanted = members.filter("kind = 1").select("key").distinct().join(pairs, "key")
    needed = checkpointed(wanted.select("key").unionByName(wanted.select(F.col("next_key").alias("key"))).distinct())
    edited = edited_texts(restrict(docs, needed, "key"), wanted).select("key", F.lit(1).alias("kind"), canonical(F.col("edited")).alias("canon"))
    odd = differing(members.join(plain.unionByName(edited), ["key", "kind"]))
    odd = checkpointed(odd.groupBy("key").agg(F.max(F.when(F.col("kind") == 0, F.col("own"))).alias("t_own"), F.max(F.when(F.col("kind") == 1, F.col("own"))).alias("e_own")))
    shown = lambda k: F.concat(hex128(F.col(f"{k}1"), F.col(f"{k}2")), F.coalesce(F.concat(F.lit(":"), F.col(f"{k}_own")), F.lit("")))
    named = facts.join(odd, "key", "left").select("key", "next_key", "n_chars", "edited_sha256", shown("t").alias("fingerprint"), shown("e").alias("edited_fingerprint"))
    after = named.select(F.col("key").alias("next_key"), F.col("fingerprint").alias("next_fingerprint"))
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return named.join(after, "next_key").select(
        shown_id(named), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next")
    )
