"""Column functions on raw-signal arrays and base qualities; all native expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that every event is resampled to.
POINTS = 36


def let(value: Column, use) -> Column:
    """use(value) with the value made once: Spark puts an expression that is named once in the place of its name, and
    inside a lambda makes it anew for each element."""
    return F.transform(F.array(value), use)[0]


def to_picoampere(raw: Column, offset: Column, range_: Column, digitisation: Column) -> Column:
    return F.transform(raw, lambda x: (x + offset) * (range_ / digitisation))


def rescale(current: Column, shift: Column, scale: Column) -> Column:
    return F.transform(current, lambda x: (x - shift) / scale)


def event_samples(raw: Column, start: Column, end: Column) -> Column:
    """Samples [start, end) of a read, last first, as RNA passes the pore backwards."""
    return F.reverse(F.slice(raw, start + 1, end - start))


def mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def compress(x: Column, points: int = POINTS) -> Column:
    """`points` window means of at least as many samples; the longer windows come first."""
    n = F.size(x)
    q, r = F.floor(n / points).cast("int"), (n % points).cast("int")

    def window(i):
        start = i * q + F.least(i, r)
        return mean(F.slice(x, start + 1, q + F.when(i < r, 1).otherwise(0)))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), window)


def interpolate(x: Column, points: int = POINTS) -> Column:
    """`points` values on the lines between fewer samples; gaps with more steps come first. One sample
    gives a constant, none null."""
    gaps = F.size(x) - 1
    q, r = F.floor((points - 1) / gaps).cast("int"), ((points - 1) % gaps).cast("int")

    def gap(i):
        steps = q + F.when(i < r, 1).otherwise(0)
        left, right = F.get(x, i), F.get(x, i + 1)
        return F.transform(F.sequence(F.lit(0), steps - 1), lambda j: left + j * (right - left) / steps)

    lines = F.flatten(F.transform(F.sequence(F.lit(0), gaps - 1), gap))
    whole = F.concat(lines, F.array(F.try_element_at(x, F.lit(-1))))
    return F.when(F.size(x) == 1, F.array_repeat(F.get(x, F.lit(0)), points)).when(F.size(x) > 1, whole)


def resample(x: Column, points: int = POINTS) -> Column:
    return F.when(F.size(x) >= points, compress(x, points)).otherwise(interpolate(x, points))


def noise(x: Column, level: int, key: Column) -> Column:
    """A whole number from -level to level added to each sample, drawn from a hash of key and place."""
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.transform(x, lambda v, i: v + draw(i) % (2 * level + 1) - level)


def phred_adjust(q: Column, called: Column, reference: Column) -> Column:
    """Quality that the reference base is right: q where it was called, of 1 - error where not; 0 stays 0."""
    wrong = -10 * F.log10(1 - F.pow(F.lit(10.0), -q / 10.0))
    return F.when(q == 0, F.lit(0.0)).when(called == reference, q.cast("double")).otherwise(wrong)


def fill_zeros(q: Column) -> Column:
    """Zeros replaced by the mean of the others; null if there are none."""

    def filled(x):
        some = F.filter(x, lambda v: v != 0)
        full = let(let(some, mean), lambda m: F.transform(x, lambda v: F.when(v == 0, m).otherwise(v)))
        return F.when(F.exists(x, lambda v: v != 0), full)

    return let(q, filled)
