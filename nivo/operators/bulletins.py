"""Bulletins: one record and text per zone and forecast date, for all zones in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivo.functions import bands, keys, templates
from nivo.functions.numbers import fixed
from nivo.operators import frames

HIGH_RISK_LEVEL = 3


def _lines(items: Column) -> Column:
    return F.array_join(items, "\n")


def _any(items: Column, *needles: str, lower: bool = True) -> Column:
    def matches(item: Column) -> Column:
        text = F.lower(item) if lower else item
        found = [F.contains(text, F.lit(n)) for n in needles]
        return found[0] if len(found) == 1 else found[0] | _either(found[1:])

    def _either(rest: list[Column]) -> Column:
        return rest[0] if len(rest) == 1 else rest[0] | _either(rest[1:])

    return F.exists(items, matches)


def problems(factors: Column) -> Column:
    """Problem tags of a bulletin record, from its factor phrases."""
    found = F.array_compact(
        F.array(
            F.when(_any(factors, "nevada", "nieve reciente"), "Nieve reciente"),
            F.when(_any(factors, "viento"), "Placas de viento"),
            F.when(_any(factors, "térmica", "temperatura", "fluctuación"), "Nieve húmeda"),
            F.when(_any(factors, "pendiente"), "Terreno crítico"),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Condiciones estables")))


def text_problems(factors: Column) -> Column:
    """Problem lines of the bulletin text: each factor gives its first matching line."""

    def line(factor: Column) -> Column:
        text = F.lower(factor)
        return (
            F.when(text.contains("nevada"), templates.SNOW_PROBLEM)
            .when(text.contains("viento"), templates.WIND_PROBLEM)
            .when(text.contains("térmica") | text.contains("temperatura"), templates.WET_PROBLEM)
            .when(text.contains("pendiente"), templates.TERRAIN_PROBLEM)
        )

    found = F.array_distinct(F.array_compact(F.transform(factors, line)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(templates.NO_PROBLEM)))


def aggregate(predictions: DataFrame) -> DataFrame:
    """One row per zone and forecast date: level, bands by falling score, factors, metadata.

    Predictions written more than once are reduced to the newest per zone, date and band,
    so a group has at most one row per elevation band.
    """
    stamp = [F.desc("prediction_timestamp")] if "prediction_timestamp" in predictions.columns else []
    unique = frames.newest_per_key(
        predictions, ["zone_name", "forecast_date", "elevation_band"], [*stamp, F.desc("risk_score")]
    )
    band = F.struct("risk_score", "elevation_band", "eaws_level", "eaws_label", "main_factors")
    grouped = unique.groupBy("zone_name", F.col("forecast_date").alias("issue_date")).agg(
        F.max("eaws_level").alias("eaws_level"),
        F.sort_array(F.collect_list(band), asc=False).alias("bands"),
    )
    risky = F.filter("bands", lambda b: b["eaws_level"] >= HIGH_RISK_LEVEL)
    listed = F.array_join("high_risk_bands", ", ")
    some = F.size("high_risk_bands") > 0
    return (
        grouped.withColumns(
            {
                "eaws_label": bands.danger_attribute(F.col("eaws_level"), "label"),
                "high_risk_bands": F.transform(risky, lambda b: b["elevation_band"]),
                "factors": F.array_distinct(F.flatten(F.transform("bands", lambda b: b["main_factors"]))),
            }
        )
        .withColumns(
            {
                "valid_from": F.date_add("issue_date", 1),
                "valid_to": F.date_add("issue_date", 2),
                "summary": F.concat(
                    F.lit("Nivel "),
                    F.col("eaws_level").cast("string"),
                    F.lit(" - "),
                    F.col("eaws_label"),
                    F.lit(" para "),
                    F.col("zone_name"),
                    F.lit(". "),
                    F.when(some, F.concat(F.lit("Condiciones críticas en "), listed, F.lit("."))).otherwise(
                        "Condiciones estables."
                    ),
                ),
                "danger_description": bands.danger_attribute(F.col("eaws_level"), "description"),
                "avalanche_problems": problems(F.col("factors")),
                "affected_elevations": F.when(some, listed).otherwise("Todas las elevaciones"),
                "affected_aspects": F.lit("Todas las orientaciones"),
                "recommendations": bands.danger_attribute(F.col("eaws_level"), "recommendations"),
            }
        )
    )


def _band_lines(line) -> Column:
    return _lines(F.transform("bands", line))


def render(aggregated: DataFrame) -> DataFrame:
    """Add ``bulletin_text`` to aggregated bulletins."""

    def padded(name: Column) -> Column:
        return F.when(F.length(name) >= 15, name).otherwise(F.rpad(name, 15, " "))

    def band_line(b: Column) -> Column:
        return F.concat(
            F.lit("  • "),
            padded(b["elevation_band"]),
            F.lit(": Nivel "),
            b["eaws_level"].cast("string"),
            F.lit(" - "),
            b["eaws_label"],
            F.lit("\n"),
        )

    def factor_line(factor: Column, i: Column) -> Column:
        return F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), factor, F.lit("\n"))

    factors = F.col("factors")
    names = F.transform("bands", lambda b: b["elevation_band"])
    listed, some = F.array_join("high_risk_bands", ", "), F.size("high_risk_bands") > 0
    level = F.col("eaws_level")
    advice = bands.steps(level, list(templates.ADVICE.items()), op=Column.__eq__)
    values = {
        "zone": F.col("zone_name"),
        "zone_upper": F.upper("zone_name"),
        "issue_date": F.date_format("issue_date", "dd/MM/yyyy"),
        "valid_from": F.date_format("valid_from", "dd/MM/yyyy"),
        "valid_to": F.date_format("valid_to", "dd/MM/yyyy"),
        "level": level,
        "label": F.col("eaws_label"),
        "label_upper": F.upper("eaws_label"),
        "color": bands.danger_attribute(level, "color"),
        "situation": F.when(
            some, F.concat(F.lit("Se identificaron condiciones críticas en elevaciones "), listed, F.lit("."))
        ).otherwise("Las condiciones son generalmente estables."),
        "band_lines": F.array_join(F.transform("bands", band_line), ""),
        "problem_lines": _lines(text_problems(factors)),
        "elevations": F.when(_any(names, "Alta", "Media", lower=False), "Sobre 2500m").otherwise(
            "Todas las elevaciones"
        ),
        "factor_lines": F.array_join(F.transform(factors, factor_line), ""),
        "snow": F.when(_any(factors, "Nevada", lower=False), "Moderadas a intensas").otherwise("Leves o ausentes"),
        "wind": F.when(_any(factors, "Viento", lower=False), "Fuerte, con formación de placas").otherwise("Moderado"),
        "temperature": F.when(
            _any(factors, "térmica", "fluctuación"), "Fluctuante con riesgo de deshielo"
        ).otherwise("Estable"),
        "advice": advice,
        "avoid": F.when(some, listed).otherwise("Evaluar según condiciones locales"),
    }
    return aggregated.withColumn("bulletin_text", templates.fill(templates.BULLETIN, values))


def records(aggregated: DataFrame) -> DataFrame:
    """Bulletin records with their rule-based text."""
    return render(aggregated).select(
        keys.bulletin_id(F.col("issue_date"), F.col("zone_name")).alias("boletin_id"),
        "zone_name",
        "issue_date",
        "valid_from",
        "valid_to",
        "eaws_level",
        "eaws_label",
        "summary",
        "danger_description",
        "avalanche_problems",
        "affected_elevations",
        "affected_aspects",
        "recommendations",
        F.lit("Media").alias("confidence"),
        "bulletin_text",
        F.lit("Template_System").alias("generated_by"),
    )


def prompts(aggregated: DataFrame) -> DataFrame:
    """The prompt a language model would get for each zone and date."""

    def line(b: Column) -> Column:
        return F.concat(
            F.lit("- "),
            b["elevation_band"],
            F.lit(": Nivel "),
            b["eaws_level"].cast("string"),
            F.lit(" ("),
            b["eaws_label"],
            F.lit("), Score: "),
            fixed(b["risk_score"], 2),
            F.lit(", Factores: "),
            F.array_join(b["main_factors"], ", "),
        )

    values = {
        "zone": F.col("zone_name"),
        "issue_date": F.date_format("issue_date", "yyyy-MM-dd"),
        "valid_from": F.date_format("valid_from", "yyyy-MM-dd"),
        "valid_to": F.date_format("valid_to", "yyyy-MM-dd"),
        "band_lines": _band_lines(line),
    }
    return aggregated.select("zone_name", "issue_date", templates.fill(templates.PROMPT, values).alias("prompt"))
