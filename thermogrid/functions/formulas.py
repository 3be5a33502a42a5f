"""Row-wise formulas of surface, comfort and energy-balance physics, as SQL expressions over columns.

Every formula is a function of SQL fragments (column names or expressions) and returns one; ``column`` turns it
into a Spark Column, so Catalyst sees built-in operators only.  Gaps are NULL: a clip keeps NULL, and a
division by zero is NULL.  Number literals with a decimal point are doubles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants.
SIGMA, KAPPA, ZERO_C, CP, RHO_AIR, GAMMA = 5.670374419e-8, 0.40, 273.15, 1004.0, 1.2, 0.066
LAMBDA_B10, RHO_PLANCK = 10.895e-6, 1.438e-2
# Storage-heat coefficients (a1, a2, a3) by cover.
OHM = {"impervious_frac": (0.70, 0.32, -38.0), "green_frac": (0.30, 0.18, -27.0), "tree_frac": (0.27, 0.13, -23.0), "water_frac": (0.50, 0.21, -39.0)}
# Range that a perturbed layer is clipped to.
CLIP = {"ndvi": (-1.0, 0.95), "evi": (-1.0, 1.0), "savi": (-1.0, 1.0), "ndwi": (-1.0, 1.0), "mndwi": (-1.0, 1.0), "fvc": (0.0, 1.0), "lai": (0.0, 8.0), "albedo": (0.05, 0.90), "emissivity": (0.85, 0.995), "impervious_frac": (0.0, 1.0), "green_frac": (0.0, 1.0), "water_frac": (0.0, 1.0), "tree_frac": (0.0, 1.0), "svf": (0.05, 1.0), "soil_moisture": (0.0, 0.6), "et": (0.0, 1e4)}


def exact(text: str) -> str:
    """Doubles for all literals with a decimal point, in Spark and elsewhere."""
    return re.sub(r"(?<![\w.])(\d+\.\d*)(?![\w.])", r"\1e0", text)


def column(text: str) -> Column:
    return F.expr(exact(text))


def clip(x: str, lo: float | str | None = None, hi: float | str | None = None) -> str:
    inner = f"({x})" if hi is None else f"least(({x}), {hi})"
    inner = inner if lo is None else f"greatest({inner}, {lo})"
    return f"CASE WHEN ({x}) IS NOT NULL THEN {inner} END"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0.0))"


def steps(x: str, bounds: list[float], missing: int = -1, down: bool = False) -> str:
    """Class of ``x`` by lower bounds: how many are reached, or the first of falling bounds that is."""
    rows = enumerate(bounds) if down else reversed(list(enumerate(bounds, 1)))
    arms = " ".join(f"WHEN ({x}) >= {b} THEN {i}" for i, b in rows)
    return f"CASE WHEN ({x}) IS NULL THEN {missing} {arms} ELSE {len(bounds) if down else 0} END"


# --- comfort ---------------------------------------------------------------------------------------------------


def saturation_vapour_pressure(t):
    return f"(6.105 * exp(17.27 * ({t}) / (237.7 + ({t}))))"


def vapour_pressure_from_rh(t, rh):
    return f"(({rh}) / 100.0 * {saturation_vapour_pressure(t)})"


def vapour_pressure_from_dewpoint(td):
    return f"(6.11 * exp(5417.753 * (1.0 / 273.16 - 1.0 / (273.16 + ({td})))))"


def heat_index(tc, rh):
    t = f"(({tc}) * 9.0 / 5.0 + 32.0)"
    simple = f"((0.5 * ({t} + 61.0 + ({t} - 68.0) * 1.2 + ({rh}) * 0.094) + {t}) / 2.0)"
    r = f"({rh})"
    full = f"(-42.379 + 2.04901523 * {t} + 10.14333127 * {r} - 0.22475541 * {t} * {r} - 0.00683783 * {t} * {t} - 0.05481717 * {r} * {r} + 0.00122874 * {t} * {t} * {r} + 0.00085282 * {t} * {r} * {r} - 0.00000199 * {t} * {t} * {r} * {r})"
    dry = f"CASE WHEN {r} < 13.0 AND {t} BETWEEN 80.0 AND 112.0 THEN (13.0 - {r}) / 4.0 * sqrt(greatest(17.0 - abs({t} - 95.0), 0.0) / 17.0) ELSE 0.0 END"
    damp = f"CASE WHEN {r} > 85.0 AND {t} BETWEEN 80.0 AND 87.0 THEN (({r} - 85.0) / 10.0) * ((87.0 - {t}) / 5.0) ELSE 0.0 END"
    return f"((CASE WHEN {simple} >= 80.0 THEN {full} - {dry} + {damp} ELSE {simple} END - 32.0) * 5.0 / 9.0)"


def heat_index_category(hi):
    return steps(f"({hi}) * 9.0 / 5.0 + 32.0", [80, 91, 103, 125])


def humidex(t, td):
    return f"CASE WHEN ({t}) IS NOT NULL AND ({td}) IS NOT NULL THEN greatest(({t}) + 0.5555 * ({vapour_pressure_from_dewpoint(td)} - 10.0), ({t})) END"


def wet_bulb(t, rh, pressure_kpa=None):
    r = clip(rh, 1.0, 100.0)
    tw = f"(({t}) * atan(0.151977 * sqrt(({r}) + 8.313659)) + atan(({t}) + ({r})) - atan(({r}) - 1.676331) + 0.00391838 * power(({r}), 1.5) * atan(0.023101 * ({r})) - 4.686035)"
    if pressure_kpa is None:
        return tw
    return f"({tw} - (({t}) - {tw}) * ((({pressure_kpa}) * 10.0 - 1013.25) / 1013.25))"


def wbgt_simplified(t, rh):
    return f"(0.567 * ({t}) + 0.393 * {vapour_pressure_from_rh(t, rh)} + 3.94)"


def wbgt_full(t, nw, g, solar=True):
    return f"(0.7 * ({nw}) + 0.2 * ({g}) + 0.1 * ({t}))" if solar else f"(0.7 * ({nw}) + 0.3 * ({g}))"


def apparent_temperature(t, rh, wind, radiation=None):
    e = vapour_pressure_from_rh(t, rh)
    if radiation is None:
        return f"(({t}) + 0.33 * {e} - 0.7 * ({wind}) - 4.0)"
    return f"(({t}) + 0.348 * {e} - 0.7 * ({wind}) + 0.7 * ({radiation}) / (({wind}) + 10.0) - 4.25)"


def discomfort_index(t, rh):
    return f"(({t}) - (0.55 - 0.0055 * ({rh})) * (({t}) - 14.5))"


def net_effective_temperature(t, rh, wind):
    return f"(37.0 - (37.0 - ({t})) / (0.68 - 0.0014 * ({rh}) + 1.0 / (1.76 + 1.4 * power({clip(wind, 0.0)}, 0.75))) - 0.29 * ({t}) * (1.0 - 0.01 * ({rh})))"


def mean_radiant_temperature(t, solar=None, wind=None, svf="1.0", albedo="0.2"):
    """Without wind there is no convective term; wind below 0 counts as none, the sky view is cut to 0 and 1."""
    if solar is None:
        return f"({t})"
    convection = f"4.0 * sqrt({clip(wind, 0.0)})" if wind else "0.0"
    return f"(({t}) + 0.7 * (1.0 - ({albedo})) * ({solar}) * {clip(svf, 0.0, 1.0)} / (6.0 + {convection}))"


def utci(t, rh, wind="0.5", tmrt=None):
    d = f"(({tmrt}) - ({t}))" if tmrt else "0.0"
    pa = f"({vapour_pressure_from_rh(t, rh)} / 10.0)"
    w = clip(wind, 0.0)
    return f"(({t}) + 0.607 * {d} - 1.5 * ln(1.0 + {w}) + 0.020 * {d} * {w} + 0.20 * ({pa} - 1.0))"


def utci_category(u):
    return steps(u, [46, 38, 32, 26, 9, 0, -13, -27, -40], down=True)


def human_stress_count(t, rh, td):
    flags = [f"{wet_bulb(t, rh)} >= 28.0", f"{heat_index(t, rh)} * 9.0 / 5.0 + 32.0 >= 103.0", f"{humidex(t, td)} >= 40.0", f"{discomfort_index(t, rh)} >= 29.0", f"{wbgt_simplified(t, rh)} >= 28.0"]
    return "(" + " + ".join(f"CASE WHEN {f} THEN 1 ELSE 0 END" for f in flags) + ")"


def work_loss(wbgt, work="heavy"):
    bounds = {"heavy": (27.5, 29.5, 31.5), "light": (31.5, 32.0, 32.5)}[work]
    return f"CASE WHEN ({wbgt}) IS NULL THEN NULL WHEN ({wbgt}) >= {bounds[2]} THEN 0.75 WHEN ({wbgt}) >= {bounds[1]} THEN 0.5 WHEN ({wbgt}) >= {bounds[0]} THEN 0.25 ELSE 0.0 END"


# --- radiometry, spectra, cover --------------------------------------------------------------------------------


def normalized_difference(a, b):
    return ratio(f"({a}) - ({b})", f"({a}) + ({b})")


def evi(blue, red, nir):
    return f"(2.5 * {ratio(f'({nir}) - ({red})', f'({nir}) + 6.0 * ({red}) - 7.5 * ({blue}) + 1.0')})"


def savi(red, nir):
    return f"(1.5 * {ratio(f'({nir}) - ({red})', f'({nir}) + ({red}) + 0.5')})"


def lai(e):
    return clip(f"3.618 * ({e}) - 0.118", 0.0)


def fvc_square_then_clip(ndvi):
    return clip(f"power((({ndvi}) - 0.2) / 0.3, 2)", 0.0, 1.0)


def fvc_clip_then_square(ndvi):
    return f"power({clip(f'(({ndvi}) - 0.2) / 0.3', 0.0, 1.0)}, 2)"


def emissivity_threshold(ndvi):
    fv = fvc_square_then_clip(ndvi)
    return f"CASE WHEN ({ndvi}) < 0.2 THEN 0.96 WHEN ({ndvi}) > 0.5 THEN 0.985 WHEN ({ndvi}) IS NOT NULL THEN 0.985 * ({fv}) + 0.96 * (1.0 - ({fv})) + 0.005 END"


def emissivity_from_ndvi(ndvi):
    pv = fvc_square_then_clip(ndvi)
    return f"(0.985 * ({pv}) + 0.96 * (1.0 - ({pv})) + 0.005)"


def emissivity_filled(ndvi, aster13, aster14):
    fv = clip(f"(({ndvi}) - 0.2) / 0.3", 0.0, 1.0)
    return clip(f"coalesce(0.985 * ({fv}) + 0.96 * (1.0 - ({fv})) + 0.005, (({aster13}) + ({aster14})) / 2.0 * 0.001)", 0.9, 1.0)


def albedo_sentinel(b2, b3, b4, b8, b11, b12):
    return clip(f"0.2266 * ({b2}) + 0.1236 * ({b3}) + 0.1573 * ({b4}) + 0.3417 * ({b8}) + 0.1170 * ({b11}) + 0.0338 * ({b12})", 0.0, 1.0)


def albedo_landsat(b2, b4, b5, b6, b7):
    return clip(f"0.356 * ({b2}) + 0.130 * ({b4}) + 0.373 * ({b5}) + 0.085 * ({b6}) + 0.072 * ({b7}) - 0.0018", 0.0, 1.0)


def scaled(dn, scale, offset=0.0):
    return f"(({dn}) * {scale} + ({offset}))"


def celsius(k):
    return f"(({k}) - 273.15)"


def mono_window(bt, emissivity):
    return f"(({bt}) / (1.0 + ({LAMBDA_B10} * ({bt}) / {RHO_PLANCK}) * ln(({emissivity}))) - 273.15)"


def masked(value, qa, bits):
    return f"CASE WHEN (CAST(({qa}) AS BIGINT) & {bits}) = 0 THEN ({value}) END"


def diurnal_shift(x, hour, reference=13.5):
    return f"(({x}) + 6.0 * (cos(({reference} - 14.0) * 2.0 * pi() / 24.0) - cos((({hour}) - 14.0) * 2.0 * pi() / 24.0)))"


def magnus(t):
    return f"(6.112 * exp(17.67 * ({t}) / (({t}) + 243.5)))"


def relative_humidity(t, td):
    return clip(f"100.0 * {magnus(td)} / {magnus(t)}", 0.0, 100.0)


def wind_speed(u, v):
    return f"sqrt(({u}) * ({u}) + ({v}) * ({v}))"


def impervious(ghsl_m2, cell_m2, built):
    return clip(f"(({ghsl_m2}) / {cell_m2} + ({built})) / 2.0", 0.0, 1.0)


# --- morphology ------------------------------------------------------------------------------------------------


def building_height(built, dsm, dem, anbh):
    return f"coalesce(CASE WHEN ({built}) > 0.1 THEN {clip(f'({dsm}) - ({dem})', 0.0)} END, ({anbh}))"


def frontal_area_index(lp, h):
    return clip(f"({lp}) * ({h}) / (({h}) + 10.0)", 0.0, 1.0)


def aspect_ratio(lp, h, lcz_hw="NULL"):
    return f"coalesce(({lp}) / greatest(1.0 - ({lp}), 0.05) * (({h}) / 30.0 + 0.5), {lcz_hw})"


def sky_view_factor(hw):
    return f"(1.0 / sqrt(1.0 + (2.0 * ({hw})) * (2.0 * ({hw}))))"


def displacement_over_height(lp):
    return clip(f"1.0 + power(4.43, -({lp})) * (({lp}) - 1.0)", 0.0, 0.99)


def roughness_length(lp, lf, h):
    zd = displacement_over_height(lp)
    bracket = f"greatest(0.5 * (1.2 / ({KAPPA} * {KAPPA})) * (1.0 - ({zd})) * ({lf}), 0.000001)"
    return f"coalesce(greatest((1.0 - ({zd})) * exp(-power({bracket}, -0.5)) * ({h}), 0.0), 0.03)"


# --- surface energy balance ------------------------------------------------------------------------------------


def kelvin(t):
    return f"(({t}) + 273.15)"


def saturation_kpa(t):
    return f"(0.6108 * exp(17.27 * ({t}) / (({t}) + 237.3)))"


def longwave_up(lst, emissivity, down=None):
    base = f"(({emissivity}) * {SIGMA} * power({kelvin(lst)}, 4)"
    return base + (f" + (1.0 - ({emissivity})) * ({down}))" if down else ")")


def lst_from_longwave(up, emissivity, down=None):
    rest = f"({up}) - (1.0 - ({emissivity})) * ({down})" if down else f"({up})"
    return f"(power(greatest(({rest}) / (({emissivity}) * {SIGMA}), 0.000001), 0.25) - 273.15)"


def shortwave_net(albedo, k):
    return f"((1.0 - ({albedo})) * ({k}))"


def net_radiation(albedo, k, down, emissivity, lst):
    return f"({shortwave_net(albedo, k)} + ({down}) - {longwave_up(lst, emissivity, down)})"


def aerodynamic_resistance(wind, z0):
    return clip(f"power(ln(10.0 / greatest(({z0}), 0.001)), 2) / ({KAPPA} * {KAPPA} * greatest(({wind}), 0.3))", 1.0, 1e4)


def sensible_heat(lst, air, wind, z0):
    return f"({RHO_AIR} * {CP} * (({lst}) - ({air})) / ({aerodynamic_resistance(wind, z0)}))"


def latent_heat(lst, air, rh, wind, z0, rs="100.0"):
    return f"({RHO_AIR} * {CP} / {GAMMA} * greatest({saturation_kpa(lst)} - ({rh}) / 100.0 * {saturation_kpa(air)}, 0.0) / (({aerodynamic_resistance(wind, z0)}) + ({rs})))"


def bowen_ratio(h, e):
    return f"(({h}) / greatest(abs(({e})), 1.0) * sign(({e}) + 1e-12))"


def storage_heat(q, covers: dict[str, str], rate="0.0"):
    covers = covers or {"impervious_frac": "1.0"}
    return "(" + " + ".join(f"({f}) * ({OHM[n][0]} * ({q}) + {OHM[n][1]} * ({rate}) + ({OHM[n][2]}))" for n, f in covers.items()) + ")"


def vegetation(green, tree):
    return clip(f"({green}) + 0.5 * ({tree})", 0.0, 1.0)


def physics_lst(air, albedo, k, down, emissivity, green, tree, water, imperv, sm, wind, qf):
    veg = vegetation(green, tree)
    q = f"({shortwave_net(albedo, k)} + ({emissivity}) * (({down}) - {SIGMA} * power({kelvin(air)}, 4)) + ({qf}))"
    ef = clip(f"0.30 + 0.55 * ({veg}) + 0.62 * ({water}) + 0.30 * ({clip(f'({sm}) / 0.4', 0.0, 1.0)}) + 0.08 * ({clip(f'({wind}) / 5.0', 0.0, 1.0)})", 0.10, 0.92)
    sf = clip(f"0.35 * ({imperv}) + 0.08", 0.0, 0.45)
    rf = clip(f"1.0 - ({ef}) - ({sf})", 0.02, 0.70)
    emitted = f"(({emissivity}) * {SIGMA} * power({kelvin(air)}, 4) + ({rf}) * {q})"
    return f"(power(greatest({emitted}, ({emissivity}) * {SIGMA} * power(233.15, 4)) / (({emissivity}) * {SIGMA}), 0.25) - 273.15)"


def seb_residual(lst, air, wind, z0, rh, sm, green, tree, water, imperv, q, qf):
    veg = vegetation(green, tree)
    rs = f"CASE WHEN ({water}) > 0.5 THEN 10.0 ELSE 20.0 + 4000.0 * (1.0 - ({veg})) * (1.0 - ({clip(f'({sm}) / 0.4', 0.0, 1.0)})) END"
    stored = storage_heat(q, {"impervious_frac": imperv, "green_frac": green, "tree_frac": tree, "water_frac": water})
    return f"abs(({q}) - ({sensible_heat(lst, air, wind, z0)} + {latent_heat(lst, air, rh, wind, z0, rs)} + {stored} + ({qf})))"


def albedo_to_delta(da, k="800.0", emissivity="0.95", lst="35.0"):
    return f"(-({da}) * ({k}) / (4.0 * ({emissivity}) * {SIGMA} * power({kelvin(lst)}, 3)))"


def et_to_delta(mm_day, emissivity="0.95", lst="35.0"):
    return f"(-(2450000.0 * 1000.0 * ({mm_day}) / 1000.0 / 86400.0) / (4.0 * ({emissivity}) * {SIGMA} * power({kelvin(lst)}, 3)))"


# --- classes, feasibility, interventions -----------------------------------------------------------------------


def eei_class(u):
    return f"CASE WHEN ({u}) IS NULL THEN -1 WHEN ({u}) <= 0.0 THEN 0 WHEN ({u}) <= 0.005 THEN 1 WHEN ({u}) <= 0.010 THEN 2 WHEN ({u}) <= 0.015 THEN 3 WHEN ({u}) <= 0.020 THEN 4 ELSE 5 END"


def priority_class(score):
    return f"CASE WHEN ({score}) IS NULL THEN -1 WHEN ({score}) >= 80 THEN 4 WHEN ({score}) >= 60 THEN 3 WHEN ({score}) >= 40 THEN 2 WHEN ({score}) >= 20 THEN 1 ELSE 0 END"


def feasible(kind, imperv="impervious_frac", ndvi="ndvi", water="water_frac", height="building_height"):
    rules = {
        "roof": f"{imperv} >= 0.30",
        "plantable": f"{imperv} <= 0.70 AND {ndvi} <= 0.55 AND {water} < 0.5",
        "paved": f"{imperv} >= 0.55 AND {ndvi} <= 0.55",
        "open": f"{imperv} <= 0.40 AND {water} < 0.5",
        "vacant": f"{imperv} <= 0.50 AND {water} < 0.5 AND {ndvi} <= 0.70",
        "facade": f"{height} >= 6.0",
        "any": "TRUE",
    }
    return f"coalesce({rules[kind]}, FALSE)"


def perturbed(layer, delta, mask):
    """The layer after a change on masked cells; the whole layer is clipped to its range."""
    lo, hi = CLIP[layer]
    return clip(f"{layer} + CASE WHEN {mask} THEN {delta} ELSE 0.0 END", f"({lo})", hi)


def clip_cooling(d):
    return f"CASE WHEN ({d}) < -0.5 THEN 0.0 WHEN ({d}) IS NULL THEN 0.0 ELSE least(({d}), 50.0) END"


def shade_index(tree):
    return clip(tree, 0.0, 1.0)


def crop_coefficient(tree, green, water, imperv):
    """Plants 1, water 1.05, sealed and bare ground 0.2, by their shares; the larger of trees and green is the plants'."""
    veg, sealed = clip(f"greatest(({tree}), ({green}))", 0.0, 1.0), clip(imperv, 0.0, 1.0)
    bare = clip(f"1.0 - {veg} - ({water}) - {sealed}", 0.0, 1.0)
    total = f"({veg} + ({water}) + {sealed} + {bare})"
    return f"(({veg} + 1.05 * ({water}) + 0.2 * {sealed} + 0.2 * {bare}) / CASE WHEN {total} > 1e-6 THEN {total} ELSE 1.0 END)"


def cooling_capacity(shade, albedo, eti):
    return clip(f"0.6 * ({shade}) + 0.2 * ({albedo}) + 0.2 * ({eti})", 0.0, 1.0)


def physics_delta(da, k, emissivity, lst, dgreen, dsm):
    d = f"(4.0 * ({emissivity}) * {SIGMA} * power({clip(kelvin(lst), 200.0, 360.0)}, 3))"
    return f"((({da}) * ({k}) + 0.25 * ({k}) * ({dgreen}) + 0.5 * ({k}) * ({dsm})) / {d})"


def solweig_tmrt(lst, svf, dsvf="0.0"):
    return f"(({lst}) + (({svf}) - 0.5) * 6.0 + 6.0 * ({dsvf}))"
