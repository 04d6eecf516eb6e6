"""Feature names: channel, family, phrase; and sentences built from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from daywatch import fixed


def _one_of(col: Column, options: dict[str, Column], default: str | None) -> Column:
    out = F.lit(default)
    for name, condition in reversed(options.items()):
        out = F.when(condition, name).otherwise(out)
    return out


def channel_of(feature: Column) -> Column:
    """The one behaviour channel a feature belongs to."""
    rules = {}
    for name, prefixes in fixed.CHANNEL_PREFIXES.items():
        rule = feature.rlike("^(" + "|".join(prefixes) + ")")
        flags = fixed.CHANNEL_FLAGS.get(name)
        rules[name] = rule | feature.isin(flags) if flags else rule
    return _one_of(feature, rules, "other")


def error_channel_of(feature: Column) -> Column:
    """Channel for error reports: the first matching pattern, flags first."""
    return _one_of(feature, {n: feature.rlike(p) for n, p in fixed.ERROR_CHANNEL_PATTERNS}, "Other")


def family_of(feature: Column) -> Column:
    """The name without its statistic suffix."""
    return F.regexp_replace(feature, "(" + "|".join(fixed.FAMILY_SUFFIXES) + ")$", "")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def phrase_of(feature: Column) -> Column:
    """Known phrase, else built from the statistic suffix, else underscores as spaces."""
    name = F.replace(F.trim(feature), F.lit("contribution_"), F.lit(""))
    base = F.regexp_replace(name, "(_zscore|_rolling_delta)$", "")
    human = F.coalesce(_lookup(fixed.BASE_PHRASES, base), F.replace(base, F.lit("_"), F.lit(" ")))
    spike = F.when(base.rlike("(_count|_sent)$"), "sudden spike in ").otherwise("sudden increase in ")
    return F.coalesce(
        _lookup(fixed.FEATURE_PHRASES, name),
        F.when(name.rlike("_zscore$"), F.concat(F.lit("unusually high "), human))
        .when(name.rlike("_rolling_delta$"), F.concat(spike, human))
        .otherwise(F.replace(name, F.lit("_"), F.lit(" "))),
    )


def parse_contributors(text: Column) -> Column:
    """Stored contributor text to array<struct<feature, value>>.

    Reads lists of pairs in JSON or in Python notation, and lists of objects with
    feature and value; anything else is an empty array.
    """
    json_like = F.regexp_replace(F.regexp_replace(F.trim(text), r"\(", "["), r",?\s*\)", "]")
    json_like = F.regexp_replace(json_like, "'", '"')
    pairs = F.from_json(json_like, "array<array<string>>")
    objects = F.from_json(text, "array<struct<feature:string,value:double>>")
    names = F.from_json(json_like, "array<string>")
    empty = F.array().cast("array<struct<feature:string,value:double>>")
    from_pairs = F.transform(
        pairs, lambda p: F.struct(F.get(p, 0).alias("feature"), F.get(p, 1).try_cast("double").alias("value"))
    )
    from_names = F.transform(
        names, lambda n: F.struct(n.alias("feature"), F.lit(None).cast("double").alias("value"))
    )
    usable = F.filter(objects, lambda o: o["feature"].isNotNull())
    return F.coalesce(
        F.when(json_like.rlike(r"^\[\s*\[") & F.forall(pairs, lambda p: p.isNotNull()), from_pairs),
        F.when(F.trim(text).rlike(r"^\[\s*\{"), usable),
        F.when(json_like.rlike(r'^\[\s*"'), from_names),
        empty,
    )


def alert_sentence(features: Column) -> Column:
    """One sentence naming up to three distinct drivers, in order, from an array of feature names."""
    labels = F.array_distinct(F.transform(features, phrase_of))
    a, b, c = F.get(labels, 0), F.get(labels, 1), F.get(labels, 2)
    count = F.size(labels)
    lead = F.lit("This alert is mainly driven by ")
    three = F.concat(
        lead, a, F.lit(", "), b, F.lit(", and "), c,
        F.when(count > 3, ", and additional signals").otherwise(""), F.lit("."),
    )
    return (
        F.when(features.isNull() | (F.size(features) == 0), "No contributor detail available for this alert.")
        .when(count == 1, F.concat(F.lit("This alert is primarily driven by "), a, F.lit(".")))
        .when(count == 2, F.concat(lead, a, F.lit(" and "), b, F.lit(".")))
        .otherwise(three)
    )


def threat_categories(features: Column) -> Column:
    """Display channels of the contributors, in order, each once."""
    display = {f: channel for channel, names in fixed.DISPLAY_CHANNELS.items() for f in names}

    def category(f: Column) -> Column:
        base = F.replace(F.replace(f, F.lit("_zscore"), F.lit("")), F.lit("_rolling_delta"), F.lit(""))
        flag = f.isin(fixed.CROSS_FLAGS) | base.isin(fixed.CROSS_FLAGS)
        return F.coalesce(_lookup(display, f), _lookup(display, base), F.when(flag, "Cross-Channel"))

    return F.array_distinct(F.filter(F.transform(features, category), lambda c: c.isNotNull()))


def suffix_columns(columns: list[str], suffixes: tuple[str, ...] = ("_zscore", "_rolling_delta")) -> list[str]:
    pattern = re.compile("(" + "|".join(suffixes) + ")$")
    return [c for c in columns if pattern.search(c)]
