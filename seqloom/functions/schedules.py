"""Noise schedules as Column expressions on t in [0, 1], in double precision, and quotas of tokens per step."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Scalar = Column | float


def _col(x: Scalar) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def in_unit(t: Column) -> Column:
    """t itself; raises where it is outside [0, 1]."""
    return F.when(t.isNull() | t.between(0.0, 1.0), t).otherwise(F.raise_error(F.concat(F.lit("t outside [0, 1]: "), t.cast("string"))).cast("double"))


@dataclass(frozen=True)
class Alpha:
    """Share of kept tokens at t, and its derivative."""

    value: Callable[[Column], Column]
    slope: Callable[[Column], Column]

    def __call__(self, t: Scalar) -> Column:
        return self.value(in_unit(_col(t)))

    def derivative(self, t: Scalar) -> Column:
        return self.slope(in_unit(_col(t)))

    def weight(self, t: Scalar) -> Column:
        return -self.derivative(t) / (1 - self(t) + 1e-6)

    def reverse_mask_prob(self, s: Scalar, t: Scalar) -> Column:
        """Probability that a token masked at t still is at s; needs 0 <= s < t <= 1."""
        s, t = _col(s), _col(t)
        ok = (s >= 0) & (s < 1) & (t > 0) & (t <= 1) & (s < t)
        return F.when(ok, (1 - self(s)) / (1 - self(t))).otherwise(F.raise_error("needs 0 <= s < t <= 1").cast("double"))


@dataclass(frozen=True)
class Kappa:
    """Share of target tokens at t, and its derivative."""

    value: Callable[[Column], Column]
    slope: Callable[[Column], Column]

    __call__ = Alpha.__call__
    derivative = Alpha.derivative

    def weight(self, t: Scalar) -> Column:
        return self.derivative(t) / (1 - self(t) + 1e-6)


def cubic_kappa(a: float = 1.0, b: float = 1.0) -> Kappa:
    return Kappa(
        lambda t: (a + 1) * t * t * t - (a + b + 1) * t * t + (b + 1) * t,
        lambda t: 3 * (a + 1) * t * t - 2 * (a + b + 1) * t + (b + 1),
    )


_HALF = math.pi / 2
ALPHAS: dict[str, Alpha] = {
    "linear": Alpha(lambda t: 1 - t, lambda t: t * 0 - 1),
    "cosine": Alpha(lambda t: 1 - F.cos(_HALF * (1 - t)), lambda t: -_HALF * F.sin(_HALF * (1 - t))),
}
#: The same values for one number on the driver.
NUMBERS: dict[str, Callable[[float], float]] = {"linear": lambda t: 1 - t, "cosine": lambda t: 1 - math.cos(_HALF * (1 - t))}
KAPPAS: dict[str, Kappa] = {
    "cubic": cubic_kappa(),
    "linear": cubic_kappa(-1.0, 0.0),
    "cosine": Kappa(lambda t: 1 - F.cos(_HALF * t), lambda t: _HALF * F.sin(_HALF * t)),
}


def _make(registry: dict, name: str):
    key = name.lower()
    if key not in registry:
        raise ValueError(f"unknown schedule {name!r}; known: {', '.join(sorted(registry))}")
    return registry[key]


def alpha(name: str) -> Alpha:
    """By name, any case. Own schedules go into ALPHAS."""
    return _make(ALPHAS, name)


def kappa(name: str) -> Kappa:
    return _make(KAPPAS, name)


def transfer_quota(masked: Column, steps: int, schedule: Alpha, keep_zeros: bool = False, draw: Callable[[Column, Column, int], Column] | None = None) -> Column:
    """Tokens to reveal per step: round-half-even of what the schedule expects of the rest, zeros dropped.

    draw(rest, probability, step) replaces the rounding for stochastic quotas.
    """
    zero = F.struct(masked.cast("long").alias("rest"), F.array().cast("array<long>").alias("got"))
    state = zero
    for k in range(steps):
        t, s = (steps - k) / steps, (steps - k - 1) / steps
        # a lambda over one element binds the state once, so the expression stays linear in the steps
        state = F.element_at(F.transform(F.array(state), _step(1 - schedule.reverse_mask_prob(s, t), k, draw)), 1)
    got = state["got"]
    return got if keep_zeros else F.filter(got, lambda n: n > 0)


def _step(prob: Column, k: int, draw: Callable[[Column, Column, int], Column] | None) -> Callable[[Column], Column]:
    def step(x: Column) -> Column:
        want = draw(x["rest"], prob, k) if draw else F.bround(x["rest"].cast("double") * prob).cast("long")
        n = F.least(want, x["rest"])
        return F.struct((x["rest"] - n).alias("rest"), F.concat(x["got"], F.array(n)).alias("got"))

    return step


def planned_quota(masked: int, steps: int, value: Callable[[float], float]) -> list[int]:
    """transfer_quota for one number, without zeros."""
    rest, got = masked, []
    for k in range(steps):
        t, s = (steps - k) / steps, (steps - k - 1) / steps
        n = min(round(rest * (1 - (1 - value(s)) / (1 - value(t)))), rest)
        rest -= n
        got.append(n)
    return [n for n in got if n > 0]


def binomial_draw(key: Column, seed: int | str) -> Callable[[Column, Column, int], Column]:
    """For transfer_quota: of `rest` tokens each is revealed with the step's probability; draws by key, step and token."""
    from .rng import uniform

    def draw(rest: Column, prob: Column, step: int) -> Column:
        one = lambda i: (uniform(F.concat_ws("/", key.cast("string"), F.lit(str(step)), i.cast("string")), seed) < prob).cast("long")
        places = F.when(rest > 0, F.sequence(F.lit(1).cast("long"), F.greatest(rest, F.lit(1).cast("long"))))
        return F.coalesce(F.aggregate(F.transform(places, one), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))

    return draw


def even_quota(n: Column, steps: Column | int) -> Column:
    """n div steps each, one more for the first n % steps."""
    k = steps.cast("long") if isinstance(steps, Column) else F.lit(steps).cast("long")
    base, extra = F.floor(n / k), n % k
    return F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: base + F.when(i < extra, 1).otherwise(0))


def step_quota(masked: Column, s: Column, t: Column, last: Column) -> Column:
    """int(masked (1 - s / t)), everything at the last step."""
    return F.when(last, masked).otherwise(F.floor(masked * (1 - s / t))).cast("long")
