"""Scalar expressions: units, maps, voltages, clocks, arrays, money."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres per degree of longitude and latitude at the middle of the model's region.
KM_X, KM_Y = 71.5, 111.0


def mapped(key: Column, table: Mapping, default=None) -> Column:
    """Look a key up in a small literal table; ``default`` for what it lacks."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], F.lit(default)) if table else F.lit(default)


def voltage_of(mw: Column) -> Column:
    """The level that a capacity connects to: above 120 MW 380 kV, above 20 MW 220 kV, else 110 kV."""
    return F.when(mw > 120, 380).when(mw > 20, 220).otherwise(110)


def corrected_voltage(registered: Column, mw: Column) -> Column:
    """Registered level; by capacity if there is none, and one step down at a time if the capacity is far too small for it."""
    return F.when(registered.isNull(), voltage_of(mw)).when((registered == 380) & (mw <= 20), 110).when((registered == 380) & (mw <= 120), 220).when((registered == 220) & (mw <= 20), 110).otherwise(registered)


def capacity_mva(amps: Column, kv: Column) -> Column:
    """sqrt(3) * V * I / 1000 with V in kV and I in A."""
    return F.sqrt(F.lit(3.0)) * kv * amps / 1000


def per_unit(ohm: Column, kv: Column, mva: Column) -> Column:
    return ohm / (kv * kv / mva)


def clamped_phase(angle: Column) -> Column:
    """Phase-shifter angles beyond 90 degrees count as 25, beyond 45 as 20, sign kept."""
    return F.when(F.abs(angle) > 90, F.signum(angle) * 25).when(F.abs(angle) > 45, F.signum(angle) * 20).otherwise(angle)


def finite_or_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def zero_padded(key: Column, width: int = 8) -> Column:
    """Pad with zeros on the left; longer keys stay whole, null stays null."""
    return F.when(F.length(key) < width, F.lpad(key, width, "0")).otherwise(key)


def locale_number(text: Column) -> Column:
    """A number with decimal comma, narrow spaces or a lone dash; null if it is none."""
    return F.regexp_replace(F.regexp_replace(text, "[\\u00a0\\u202f ]", ""), ",", ".").try_cast("double")


def first_limit(fixed: Column, periods: Sequence[Column]) -> Column:
    """The fixed value if it is positive, else the largest positive one of the periods, else null."""
    positive = [F.when(p > 0, p) for p in periods]
    return F.coalesce(F.when(fixed > 0, fixed), F.greatest(*positive) if len(positive) > 1 else positive[0])


def equirect_km(x0: Column, y0: Column, x1: Column, y1: Column, km_x: float = KM_X, km_y: float = KM_Y) -> Column:
    return F.sqrt(F.pow((x0 - x1) * km_x, F.lit(2)) + F.pow((y0 - y1) * km_y, F.lit(2)))


def haversine_km(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    a = F.pow(F.sin(F.radians(y1 - y0) / 2), F.lit(2)) + F.cos(F.radians(y0)) * F.cos(F.radians(y1)) * F.pow(F.sin(F.radians(x1 - x0) / 2), F.lit(2))
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def srmc(fuel: Column, efficiency: Column, co2: Column, co2_price: Column, vom: Column, heat: Column) -> Column:
    """Short-run marginal cost: fuel and carbon through the efficiency, plus variable cost, less a heat credit."""
    return fuel / efficiency + co2 * co2_price / efficiency + vom - heat


def peak_mw(annual_mwh: Column) -> Column:
    return annual_mwh / 8760 * 1.49


# Carriers by least factor, and the prices (EUR/MWh) that redispatch imputes or defaults to.
RENEWABLE = ("solar", "onwind", "offwind", "run_of_river", "reservoir", "biogas", "biomass", "waste")
HEAT_BOUND = ("gas_chp",)
IMPUTED_PRICE = {"solar": 45.0, "onwind": 85.0, "offwind": 110.0, "run_of_river": 30.0, "reservoir": 40.0, "biogas": 60.0, "biomass": 60.0, "waste": 30.0}
DEFAULT_PRICE = {"gas_chp": 65.0, "gas_ccgt": 100.0, "coal": 90.0, "hard_coal": 90.0, "lignite": 50.0, "oil": 150.0, "other": 80.0, "hydrogen": 200.0}


def redispatch_weight(carrier: Column) -> Column:
    """Least-factor weight: 10 for renewables, 5 for combined heat and power, 1 otherwise."""
    return F.when(carrier.isin(*RENEWABLE), 10.0).when(carrier.isin(*HEAT_BOUND), 5.0).otherwise(1.0)


def redispatch_price(carrier: Column, cost: Column) -> Column:
    """The unit's own cost if positive, else an imputed or default price by carrier, else 50."""
    return F.when(cost > 0, cost).otherwise(mapped(carrier, IMPUTED_PRICE | DEFAULT_PRICE, 50.0))


def snapped_up(mw: Column, ladder: Sequence[float], headroom: float = 1.3) -> Column:
    """The least step of the ladder that holds mw with headroom; the last one if none does."""
    steps = F.array(*[F.lit(float(s)) for s in sorted(ladder)])
    return F.coalesce(F.try_element_at(F.filter(steps, lambda s: s >= mw * headroom), F.lit(1)), F.lit(float(max(ladder))))


def hour_of_year(ts: Column) -> Column:
    """Hours since the year began."""
    return F.floor((F.unix_timestamp(ts) - F.unix_timestamp(F.date_trunc("year", ts))) / 3600).cast("int")


def not_leap_day(ts: Column) -> Column:
    return ~((F.month(ts) == 2) & (F.dayofmonth(ts) == 29))


def sliced(series: Column, start: int, stop: int) -> Column:
    """Hours start (from 0) to before stop of an hourly array."""
    return F.slice(series, start + 1, stop - start)


def padded(series: Column, length: int, last: bool = False) -> Column:
    """Fill up to ``length`` with zeros, or with the last value; longer arrays are cut."""
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(series))
    filler = F.coalesce(F.try_element_at(series, F.lit(-1)), F.lit(0.0)) if last else F.lit(0.0)
    return F.slice(F.concat(series, F.array_repeat(filler, missing)), 1, length)


def array_total(series: Column) -> Column:
    return F.aggregate(series, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def combined(a: Column, b: Column, wa: float, wb: float) -> Column:
    """wa * a + wb * b, element by element."""
    return F.zip_with(a, b, lambda x, y: wa * x + wb * y)
