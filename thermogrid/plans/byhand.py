"""SQL for formulas, written step by step from their definitions and not from the expressions that Spark runs."""

from __future__ import annotations

#: Quantities by name, each from layers or quantities above it.
STEPS = """
    f AS (SELECT *, air_temp * 9 / 5 + 32 AS tf, rel_humidity AS r, exp(17.27 * air_temp / (237.7 + air_temp)) * 6.105 * rel_humidity / 100 AS e, 6.11 * exp(5417.7530 * (1 / 273.16 - 1 / (273.16 + dewpoint))) AS ed,
        0.6108 * exp(17.27 * lst / (lst + 237.3)) AS es_surface, 0.6108 * exp(17.27 * air_temp / (air_temp + 237.3)) AS es_air, greatest(wind_speed, 0.3) AS u, greatest(roughness_length, 0.001) AS z0, air_temp + 273.15 AS ak, lst + 273.15 AS sk,
        least(greatest(green_frac + 0.5 * tree_frac, 0), 1) AS plants FROM cells),
    h AS (SELECT *, (0.5 * (tf + 61 + (tf - 68) * 1.2 + r * 0.094) + tf) / 2 AS plain,
        -42.379 + 2.04901523 * tf + 10.14333127 * r - 0.22475541 * tf * r - 0.00683783 * tf * tf - 0.05481717 * r * r + 0.00122874 * tf * tf * r + 0.00085282 * tf * r * r - 0.00000199e0 * tf * tf * r * r AS nine,
        least(greatest(power(ln(10 / z0), 2) / (0.16 * u), 1), 10000) AS ra, (1 - albedo) * solar_radiation AS sun FROM f),
    w AS (SELECT *, CASE WHEN plain < 80 THEN plain WHEN r < 13 AND tf BETWEEN 80 AND 112 THEN nine - (13 - r) / 4 * sqrt(greatest(17 - abs(tf - 95), 0) / 17) WHEN r > 85 AND tf BETWEEN 80 AND 87 THEN nine + (r - 85) / 10 * (87 - tf) / 5 ELSE nine END AS hf,
        air_temp * atan(0.151977 * sqrt(least(greatest(r, 1), 100) + 8.313659)) + atan(air_temp + least(greatest(r, 1), 100)) - atan(least(greatest(r, 1), 100) - 1.676331) + 0.00391838 * power(least(greatest(r, 1), 100), 1.5) * atan(0.023101 * least(greatest(r, 1), 100)) - 4.686035 AS tw,
        sun + emissivity * (longwave_down - 5.670374419e-8 * power(sk, 4)) AS q_surface, sun + emissivity * (longwave_down - 5.670374419e-8 * power(ak, 4)) AS q_air,
        CASE WHEN water_frac > 0.5 THEN 10 ELSE 20 + 4000 * (1 - plants) * (1 - least(greatest(soil_moisture / 0.4, 0), 1)) END AS rs,
        least(greatest(0.30 + 0.55 * plants + 0.62 * water_frac + 0.30 * least(greatest(soil_moisture / 0.4, 0), 1) + 0.08 * least(greatest(wind_speed / 5, 0), 1), 0.10), 0.92) AS wet, least(greatest(0.35 * impervious_frac + 0.08, 0), 0.45) AS stored FROM h),
    v AS (SELECT *, 1204.8 * (lst - air_temp) / ra AS qh, 1204.8 / 0.066 * greatest(es_surface - r / 100 * es_air, 0) / (ra + 100) AS qe, 1204.8 / 0.066 * greatest(es_surface - r / 100 * es_air, 0) / (ra + rs) AS qe_city,
        impervious_frac * (0.70 * q_surface - 38) + green_frac * (0.30 * q_surface - 27) + tree_frac * (0.27 * q_surface - 23) + water_frac * (0.50 * q_surface - 39) AS qs, least(greatest(1 - wet - stored, 0.02), 0.70) AS rest,
        air_temp + 0.607 * (lst - air_temp) - 1.5 * ln(1 + greatest(wind_speed, 0)) + 0.020 * (lst - air_temp) * greatest(wind_speed, 0) + 0.20 * (e / 10 - 1) AS universal FROM w)"""

FORMULAS = {
    "heat_index": "(hf - 32) * 5 / 9",
    "humidex": "greatest(air_temp + 0.5555 * (ed - 10), air_temp)",
    "wet_bulb": "tw",
    "wet_bulb_pressure": "tw - (air_temp - tw) * (pressure * 10 - 1013.25) / 1013.25",
    "wbgt_simplified": "0.567 * air_temp + 0.393 * e + 3.94",
    "wbgt_full_sun": "0.7 * tw + 0.2 * (air_temp + 5) + 0.1 * air_temp",
    "wbgt_full_shade": "0.7 * tw + 0.3 * (air_temp + 5)",
    "apparent_temperature": "air_temp + 0.33 * e - 0.7 * wind_speed - 4",
    "apparent_temperature_radiation": "air_temp + 0.348 * e - 0.7 * wind_speed + 0.7 * solar_radiation / (wind_speed + 10) - 4.25",
    "discomfort_index": "air_temp - (0.55 - 0.0055 * r) * (air_temp - 14.5)",
    "net_effective_temperature": "37 - (37 - air_temp) / (0.68 - 0.0014 * r + 1 / (1.76 + 1.4 * power(greatest(wind_speed, 0), 0.75))) - 0.29 * air_temp * (1 - 0.01 * r)",
    "mean_radiant_temperature": "air_temp + 0.7 * (1 - albedo) * solar_radiation * least(greatest(svf, 0), 1) / (6 + 4 * sqrt(greatest(wind_speed, 0)))",
    "utci": "universal",
    "utci_category": "CASE WHEN universal IS NULL THEN -1 WHEN universal >= 46 THEN 0 WHEN universal >= 38 THEN 1 WHEN universal >= 32 THEN 2 WHEN universal >= 26 THEN 3 WHEN universal >= 9 THEN 4 WHEN universal >= 0 THEN 5 WHEN universal >= -13 THEN 6 WHEN universal >= -27 THEN 7 WHEN universal >= -40 THEN 8 ELSE 9 END",
    "aerodynamic_resistance": "ra",
    "shortwave_net": "sun",
    "net_radiation": "q_surface",
    "sensible_heat": "qh",
    "latent_heat": "qe",
    "physics_lst": "power(greatest(emissivity * 5.670374419e-8 * power(ak, 4) + rest * (q_air + anthro_heat), emissivity * 5.670374419e-8 * power(233.15, 4)) / (emissivity * 5.670374419e-8), 0.25) - 273.15",
    "seb_residual": "abs(q_surface - (qh + qe_city + qs + anthro_heat))",
    "crop_coefficient": "(greatest(tree_frac, green_frac) + 1.05 * water_frac + 0.2 * impervious_frac + 0.2 * greatest(1 - greatest(tree_frac, green_frac) - water_frac - impervious_frac, 0)) / (greatest(tree_frac, green_frac) + water_frac + impervious_frac + greatest(1 - greatest(tree_frac, green_frac) - water_frac - impervious_frac, 0))",
    "ndvi_index": "(b8 - b4) / nullif(b8 + b4, 0)",
    "evi_index": "2.5 * (b8 - b4) / nullif(b8 + 6 * b4 - 7.5 * b2 + 1, 0)",
    "savi_index": "1.5 * (b8 - b4) / nullif(b8 + b4 + 0.5, 0)",
    "shade_index": "least(greatest(tree_frac, 0), 1)",
    "albedo_sentinel": "least(greatest(0.2266 * b2 + 0.1236 * b3 + 0.1573 * b4 + 0.3417 * b8 + 0.1170 * b11 + 0.0338 * b12, 0), 1)",
}


def sql(cells: str, tie: float) -> dict[str, str]:
    return {f"fn_{n}": f"WITH {cells}, {STEPS} SELECT row, col, round(CAST({x} AS DOUBLE) + {tie!r}, 5) AS value FROM v" for n, x in FORMULAS.items()}
