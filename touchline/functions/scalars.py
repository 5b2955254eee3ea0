"""Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-15
FACTORIAL_TABLE = 60  # beyond it Stirling's series is exact to double precision
UNROLLED = 15  # goal counts that are written out term by term
MAX_RATE = 1e8  # two overlapping distributions of larger rates have hundreds of thousands of terms
DAY_MICROS = 86_400_000_000


def code_map(mapping: Mapping[str, str]) -> Column:
    """A literal map column for code translation."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


# --- time -----------------------------------------------------------------------------------


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text to a UTC instant; ``Z`` and offsets are honoured, naive text is UTC."""
    return F.try_to_timestamp(text)


def iso_date(text: Column) -> Column:
    """Date prefix of a text value, NULL when it is not a date."""
    return F.substring(text, 1, 10).try_cast("date")


def instant(ts: Column | str) -> Column:
    """Microseconds since the epoch, the time axis of every history."""
    return F.unix_micros(ts)


def end_of_day(day: Column) -> Column:
    """Last microsecond of a UTC date: ``end_of_day(d) < kickoff`` iff ``d < date(kickoff)``."""
    return F.unix_micros(F.date_add(day, 1).cast("timestamp")) - F.lit(1)


# --- coercion -------------------------------------------------------------------------------


def to_long(text: Column) -> Column:
    """Integer text to bigint, otherwise NULL."""
    return text.try_cast("bigint")


def to_double(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def leading_int(text: Column) -> Column:
    """``"180 cm"`` to 180: the first blank-separated word when it is an integer."""
    return F.get(F.split(F.trim(text), r"\s+"), F.lit(0)).try_cast("int")


def year_prefix(text: Column) -> Column:
    return F.substring(text, 1, 4).try_cast("int")


def matchday(round_name: Column) -> Column:
    """Integer after the last dash of a round name, NULL when there is none."""
    return F.nullif(F.regexp_extract(round_name, r"-\s*(\d+)\s*$", 1), F.lit("")).try_cast("int")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


# --- classes --------------------------------------------------------------------------------


def outcome_class(home_goals: Column, away_goals: Column) -> Column:
    """0 home, 1 draw, 2 away."""
    return F.when(home_goals > away_goals, 0).when(home_goals == away_goals, 1).when(home_goals < away_goals, 2)


def target_label(home_win: Column, draw: Column, away_win: Column, home_goals: Column, away_goals: Column) -> Column:
    """Class from the flags, else from the goals, else an error."""
    return F.coalesce(
        F.when(home_win == 1, 0).when(draw == 1, 1).when(away_win == 1, 2),
        outcome_class(home_goals, away_goals),
        F.raise_error(F.lit("row has neither outcome flags nor goals")).cast("int"),
    )


def argmax3(a: Column, b: Column, c: Column) -> Column:
    """Index of the largest of three; the first wins a tie."""
    return F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)


def pick3(label: Column, a: Column, b: Column, c: Column) -> Column:
    return F.when(label == 0, a).when(label == 1, b).when(label == 2, c)


def is_simplex(a: Column, b: Column, c: Column, atol: float = 1e-6) -> Column:
    """Three finite values in [0,1] whose sum is 1 within ``atol`` plus 1e-5 relative."""
    inside = [finite(x) & (x >= 0) & (x <= 1) for x in (a, b, c)]
    return F.coalesce(
        inside[0] & inside[1] & inside[2] & (F.abs(a + b + c - 1.0) <= F.lit(atol + 1e-5)), F.lit(False)
    )


def is_goal_count(x: Column) -> Column:
    """Finite, not negative and whole."""
    d = x.cast("double")
    return F.coalesce(finite(d) & (d >= 0) & (F.abs(d - F.rint(d)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.rint(d))), F.lit(False))


def softmax3(a: Column, b: Column, c: Column) -> list[Column]:
    """Softmax of three logits, shifted by their maximum."""
    top = F.greatest(a, b, c)
    parts = [F.exp(x - top) for x in (a, b, c)]
    total = parts[0] + parts[1] + parts[2]
    return [p / total for p in parts]


def clipped_log(p: Column, eps: float = EPS) -> Column:
    return F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1.0)))


def normalise3(a: Column, b: Column, c: Column) -> list[Column]:
    """Clamp each value to [0,1] and divide by the row sum."""
    clamped = [F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) for x in (a, b, c)]
    total = clamped[0] + clamped[1] + clamped[2]
    return [F.when(total > 0, x / total).otherwise(F.lit(1.0 / 3.0)) for x in clamped]


# --- ratings --------------------------------------------------------------------------------


def elo_expected(home: Column, away: Column, hfa: float = 65.0) -> Column:
    """Expected home score with the home advantage added to the home rating."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (away - (home + F.lit(hfa))) / F.lit(400.0)))


def elo_result(home_goals: Column, away_goals: Column) -> Column:
    return F.when(home_goals > away_goals, 1.0).when(home_goals < away_goals, 0.0).otherwise(0.5)


# --- goals ----------------------------------------------------------------------------------


def _log_factorials(n: int) -> Column:
    return F.array(*[F.lit(math.lgamma(k + 1.0)) for k in range(n + 1)])


def log_factorial(k: Column) -> Column:
    """log k! for small k from a literal table, larger k by Stirling's series."""
    n = k.cast("int")
    x = k.cast("double") + 1.0
    stirling = (
        (x - 0.5) * F.log(x)
        - x
        + 0.5 * math.log(2 * math.pi)
        + F.lit(1.0) / (x * 12.0)
        - F.lit(1.0) / (F.pow(x, F.lit(3.0)) * 360.0)
    )
    return F.when(n <= FACTORIAL_TABLE, F.get(_log_factorials(FACTORIAL_TABLE), n)).otherwise(stirling)


def poisson_pmf(rate: Column, max_goals: int) -> Column:
    """Array of P(k) for k = 0..max_goals, computed in log space."""
    table = _log_factorials(max_goals)
    return F.transform(
        F.sequence(F.lit(0), F.lit(max_goals)), lambda k: F.exp(-rate + k * F.log(rate) - F.get(table, k))
    )


def pmf_map(rate: Column, max_goals: int) -> Column:
    return F.map_from_arrays(F.sequence(F.lit(0), F.lit(max_goals)), poisson_pmf(rate, max_goals))


def _series(x: Column, low: int, high: int) -> Column:
    """Sum of x^i / i! for i = low..high, by Horner's rule."""
    out = F.lit(1.0)
    for i in range(high, low, -1):
        out = F.lit(1.0) + x / i * out
    first = F.lit(1.0 / math.factorial(low))
    for _ in range(low):
        first = first * x
    return first * out


def _few_goals(lh: Column, la: Column, m: int) -> list[Column]:
    """Home, draw and away sums over 0..m goals per side as polynomials of the rates."""
    scale = F.exp(-lh - la)
    square = F.lit(1.0)
    for k in range(m, 0, -1):
        square = F.lit(1.0) + lh * la / (k * k) * square

    def wins(x: Column, y: Column) -> Column:
        out = F.lit(0.0)
        for j in range(m - 1, -1, -1):  # the other side scores j
            out = _series(x, j + 1, m) + (y / (j + 1) * out if j < m - 1 else F.lit(0.0))
        return scale * out

    return [wins(lh, la), scale * square, wins(la, lh)]


def _log_pmf(rate: Column, k: Column) -> Column:
    return k * F.log(rate) - rate - log_factorial(k)


def _many_goals(lh: Column, la: Column, m: Column) -> Column:
    """Struct (h, d, a) of the sums over 0..m goals, over the counts that either side can reach at all.

    Every term comes from its own logarithm, so none depends on exp(-rate). Counts further from a rate than twelve
    deviations and 30 goals hold less than 1e-30 of its mass.
    """
    low, high = [], []
    for rate in (lh, la):
        reach = 12 * F.sqrt(rate) + 30
        low.append(F.greatest(F.lit(0.0), F.floor(rate - reach)))
        high.append(F.least(m.cast("double"), F.ceil(rate + reach)))
    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(n) for n in ("h", "d", "a", "ch", "ca")])

    def step(s: Column, k: Column) -> Column:
        ph, pa = F.exp(_log_pmf(lh, k)), F.exp(_log_pmf(la, k))
        return F.struct(
            (s["h"] + ph * s["ca"]).alias("h"), (s["d"] + ph * pa).alias("d"), (s["a"] + pa * s["ch"]).alias("a"), (s["ch"] + ph).alias("ch"), (s["ca"] + pa).alias("ca")
        )

    counts = F.sequence(F.least(*low).cast("int"), F.greatest(*high).cast("int"))
    sums = F.aggregate(counts, start, step, lambda s: F.struct(s["h"].alias("h"), s["d"].alias("d"), s["a"].alias("a")))
    sure = lambda home: F.struct(F.lit(float(home)).alias("h"), zero.alias("d"), F.lit(float(not home)).alias("a"))
    fits = (lh <= MAX_RATE) & (la <= MAX_RATE)
    return F.when(low[0] > high[1], sure(True)).when(low[1] > high[0], sure(False)).when(fits, sums)


def outcome_from_rates(home_rate: Column, away_rate: Column, max_goals: int = 10, label: Column | None = None) -> Column:
    """Struct (home, draw, away) from two independent Poisson rates, or one class's probability.

    Rates up to ``max_goals`` are summed over 0..max_goals, written out as polynomials. A larger rate widens the range
    to five deviations above it and is summed around the rates. What the range leaves out is divided away. Rates that
    are not positive and finite give NULL, as do two rates above 1e8 that lie close to each other.
    """
    widest = F.greatest(home_rate, away_rate)
    few = F.lit(False)
    short = F.struct(*[F.lit(0.0).alias(n) for n in "hda"])
    if max_goals <= UNROLLED:
        few = widest <= max_goals
        short = F.struct(*[c.alias(n) for c, n in zip(_few_goals(home_rate, away_rate, max_goals), "hda", strict=True)])
    terms = F.when(widest > max_goals, F.greatest(F.lit(float(max_goals)), F.ceil(widest + 5 * F.sqrt(widest)).cast("double"))).otherwise(F.lit(float(max_goals)))
    sums = F.when(few, short).otherwise(_many_goals(home_rate, away_rate, terms))

    def scaled(s: Column) -> Column:
        total = s["h"] + s["d"] + s["a"]
        scale = F.when(F.abs(total - 1.0) <= 1e-9, F.lit(1.0)).otherwise(total)
        if label is not None:
            return pick3(label, s["h"] / scale, s["d"] / scale, s["a"] / scale)
        parts = F.struct((s["h"] / scale).alias("home"), (s["d"] / scale).alias("draw"), (s["a"] / scale).alias("away"))
        return F.when(s.isNotNull(), parts)

    # one evaluation of the sums, whatever reads them
    return F.when(_usable(home_rate, away_rate), F.transform(F.array(sums), scaled)[0])


def over_under_25(home_rate: Column, away_rate: Column) -> Column:
    """Struct (over, under) of 2.5 goals: the total is Poisson with the summed rate."""
    s = home_rate + away_rate
    under = F.exp(-s) * (F.lit(1.0) + s + s * s / 2.0)
    return F.when(
        _usable(home_rate, away_rate),
        F.struct(F.greatest(F.lit(0.0), F.lit(1.0) - under).alias("over"), under.alias("under")),
    )


def both_score(home_rate: Column, away_rate: Column) -> Column:
    """Struct (yes, no): both sides score at least once."""
    yes = (F.lit(1.0) - F.exp(-home_rate)) * (F.lit(1.0) - F.exp(-away_rate))
    return F.when(
        _usable(home_rate, away_rate),
        F.struct(F.greatest(F.lit(0.0), yes).alias("yes"), F.greatest(F.lit(0.0), F.lit(1.0) - yes).alias("no")),
    )


def _usable(home_rate: Column, away_rate: Column) -> Column:
    return finite(home_rate) & finite(away_rate) & (home_rate > 0) & (away_rate > 0)


# --- rows -----------------------------------------------------------------------------------


def missing_count(columns: Sequence[str]) -> Column:
    parts = [F.col(c).isNull().cast("int") for c in columns]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def feature_vector(columns: Sequence[str]) -> Column:
    """float32 array in the given order; NULL becomes NaN and 0 stays 0."""
    return F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")) for c in columns])


def fold_seed(base: int | Column, fold: Column) -> Column:
    """First four bytes of SHA-256("base:fold") as an unsigned integer."""
    base_col = F.lit(base) if isinstance(base, int) else base
    digest = F.sha2(F.concat_ws(":", base_col.cast("string"), fold.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
