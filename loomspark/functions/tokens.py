"""Token arrays: the stand-in tokenizer, masks, truncation, collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bind import let

MASKED = -100
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def token_ids(text: Column, size: int = 1 << 20) -> Column:
    """Deterministic stand-in token ids: 28 bits of each word's md5, modulo size."""
    return F.transform(words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % size).cast("int"))


def masked_labels(ids: Column, scales: Column) -> Column:
    """Token where its scale counts, the mask elsewhere; the first label is always masked."""
    return F.transform(F.zip_with(ids, scales, lambda t, s: F.when(s > 0, t).otherwise(MASKED)), lambda x, i: F.when(i == 0, MASKED).otherwise(x))


def first_masked(labels: Column) -> Column:
    return F.transform(labels, lambda x, i: F.when(i == 0, MASKED).otherwise(x))


def open_suffix(labels: Column, ids: Column, suffix: list[int]) -> Column:
    """Unmask every suffix that directly follows a stretch of open labels.

    The fold carries, for each place, how many suffix tokens are still expected.
    """
    n = len(suffix)
    want = F.array(*[F.lit(s) for s in suffix])

    def of(ls: Column, ts: Column) -> Column:
        ends = F.filter(F.transform(ls, lambda x, i: F.when((i > 0) & (x == MASKED) & (F.get(ls, i - 1) != MASKED) & (F.slice(ts, i + 1, n) == want), i)), lambda i: i.isNotNull())
        return let(lambda es: F.transform(ls, lambda x, i: F.when(F.exists(es, lambda e: (i >= e) & (i < e + n)), F.get(ts, i)).otherwise(x)), ends)

    return let(of, labels, ids)


def truncated(values: Column, ids: Column, most: int, side: str, protected: list[int] | None = None) -> Column:
    """At most most tokens of an array parallel to ids; protected tokens stay, the rest is cut from a side."""
    right = side == "right"

    def cut(keep: Column, loose: Column) -> Column:
        free = F.greatest(F.lit(most) - (F.size(keep) - F.size(loose)), F.lit(0))
        edge = F.get(loose, free - 1) if right else F.get(loose, F.greatest(F.size(loose) - free, F.lit(0)))
        edge = F.when(free > 0, edge)

        def chosen(e: Column) -> Column:
            inside = (lambda i: i <= F.coalesce(e, F.lit(-1))) if right else (lambda i: i >= F.coalesce(e, F.size(keep)))
            return F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), (F.get(keep, i) | inside(i)).alias("k"))), lambda x: x["k"])["v"]

        return let(chosen, edge)

    kept = F.transform(ids, lambda t: t.isin(protected or []))
    loose = lambda k: F.filter(F.transform(k, lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())
    return F.when(F.size(ids) <= most, values).otherwise(let(lambda k: let(lambda f: cut(k, f), loose(k)), kept))


def expanded(ids: Column, placeholder: int, fill: list[int]) -> Column:
    """Every placeholder token becomes the fill tokens."""
    many = F.array(*[F.lit(f) for f in fill])
    return F.flatten(F.transform(ids, lambda t: F.when(t == placeholder, many).otherwise(F.array(t))))


def split_on(ids: Column, separator: int) -> Column:
    """Offsets of a separator token."""
    return F.filter(F.transform(ids, lambda t, i: F.when(t == separator, i)), lambda i: i.isNotNull())


def find_all(ids: Column, part: list[int]) -> Column:
    """Offsets at which a sequence of tokens starts."""
    want = F.array(*[F.lit(p) for p in part])
    return F.filter(F.transform(ids, lambda t, i: F.when((t == part[0]) & (F.slice(ids, i + 1, len(part)) == want), i)), lambda i: i.isNotNull())


def without_stop(ids: Column, stop: list[int]) -> Column:
    """A trailing stop sequence goes."""
    n = len(stop)
    want = F.array(*[F.lit(s) for s in stop])
    tail = F.when(F.size(ids) >= n, F.slice(ids, F.size(ids) - n + 1, n))
    return F.when(tail == want, F.slice(ids, 1, F.size(ids) - n)).otherwise(ids)


def padded(values: Column, size: Column, pad: Column, left: bool = False) -> Column:
    fill = F.array_repeat(pad, F.greatest(size - F.size(values), F.lit(0)).cast("int"))
    return F.concat(fill, values) if left else F.concat(values, fill)


def collate(df: DataFrame, batch: str, ids: str = "input_ids", labels: str = "labels", pad: int = 0, multiple: int = 1) -> DataFrame:
    """Pad every row of a batch to its longest one: ids, labels, attention mask.

    The longest length of a batch is one pre-aggregated number that is joined back; the token
    arrays themselves are shuffled only where that side is too large to broadcast.
    """
    longest = df.groupBy(F.col(batch).alias("__b")).agg(F.max(F.size(ids)).alias("__m"))
    size = (F.ceil(F.col("__m") / multiple) * multiple).cast("int")
    out = df.join(longest, F.col(batch).eqNullSafe(F.col("__b"))).withColumn("__s", size).drop("__b", "__m").withColumn("attention_mask", F.transform(ids, lambda _: F.lit(1)))
    for c, p in ((ids, pad), (labels, MASKED), ("attention_mask", 0)):
        out = out.withColumn(c, padded(F.col(c), F.col("__s"), F.lit(p)))
    return out.drop("__s")


def unpacked(values: Column, lengths: Column, width: int, pad: Column) -> tuple[Column, Column]:
    """Flat values -> one left-padded row for each length, and the mask of real places."""
    starts = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x))
    rows = let(lambda vs: F.transform(F.arrays_zip(starts.alias("s"), lengths.alias("n")), lambda x: F.concat(F.array_repeat(pad, F.lit(width) - x["n"]), F.slice(vs, x["s"] + 1, x["n"]))), values)
    mask = F.transform(lengths, lambda n: F.concat(F.array_repeat(F.lit(0), F.lit(width) - n), F.array_repeat(F.lit(1), n)))
    return rows, mask


def one_hot(labels: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(labels, i).cast("int"))
