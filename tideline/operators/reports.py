"""Report tables: display units, labels, text scans and consistency gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Metric: unit and label. Fixed values of the report.
METRICS = {"ann_vol": ("percent", "Annualised volatility"), "sharpe": ("ratio", "Sharpe ratio"), "max_drawdown": ("percent", "Maximum drawdown"), "cagr": ("percent", "Compound annual growth"), "ann_turnover": ("ratio", "Annual turnover"), "ann_cost": ("bps", "Annual cost"), "var95": ("percent", "95% value at risk"), "n_days": ("count", "Days")}


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("raw_value")) for m in metrics])).alias("x")).select(*keys, "x.*")


def registered(key: Column, registry: dict, kind: str) -> Column:
    """The key where the registry has it; any other raises when it is read."""
    return F.when(key.isin(*registry), key).otherwise(F.raise_error(F.concat(F.lit(f"unregistered {kind}: "), F.coalesce(key, F.lit("null")))).cast("string"))


def labels(rows: DataFrame, key: str, registry: dict[str, str]) -> DataFrame:
    """The rows with ``label``; a key that isn't registered raises."""
    table = F.create_map(*[F.lit(x) for kv in registry.items() for x in kv])
    return rows.withColumn("label", F.try_element_at(table, registered(F.col(key), registry, "label")))


def display_table(long: DataFrame) -> DataFrame:
    """raw_value with its display value, unit, label and formatted text; an unregistered metric raises."""
    long = long.withColumn("metric", registered(F.col("metric"), METRICS, "metric"))
    value = unit = label = text = None
    for m, (u, name) in METRICS.items():
        on = F.col("metric") == m
        value = F.when(on, C.to_unit(F.col("raw_value"), u)) if value is None else value.when(on, C.to_unit(F.col("raw_value"), u))
        unit = F.when(on, u) if unit is None else unit.when(on, u)
        label = F.when(on, name) if label is None else label.when(on, name)
        text = F.when(on, C.formatted(F.col("raw_value"), u)) if text is None else text.when(on, C.formatted(F.col("raw_value"), u))
    return long.withColumns({"display_value": value, "display_unit": unit, "label": label, "formatted": text})


def unit_breaches(display: DataFrame, rtol: float = 1e-12) -> DataFrame:
    """Rows without a unit, or whose display value isn't the raw value in that unit."""
    factor = F.create_map(*[F.lit(x) for u, (k, _, _) in C.UNITS.items() for x in (u, k)])
    want = F.col("raw_value") * F.try_element_at(factor, F.col("display_unit"))
    return display.filter(F.col("display_unit").isNull() | (F.abs(F.col("display_value") - want) > rtol * F.abs(want)))


def unknown(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    return rows.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def scan_text(docs: DataFrame, patterns: dict[str, str] = C.PERSONAL) -> DataFrame:
    """doc_id, kind, found: how often each pattern is in each document."""
    hits = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).cast("long").alias("found")) for k, p in patterns.items()])
    return docs.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*").filter("found > 0")


def numeric_literals(docs: DataFrame) -> DataFrame:
    """literal, n, documents: the numbers written in the texts, thousands separators dropped."""
    each = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(C.NUMBER), F.lit(0))).alias("literal"))
    each = each.withColumn("literal", F.replace("literal", F.lit(","), F.lit("")))
    return each.groupBy("literal").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


def inventory(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Gate counts: blank required fields and repeated keys."""
    blank = rows.agg(F.sum(F.greatest(*[(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("long") for c in required], F.lit(0).cast("long"))).alias("n")).select(F.lit("blank_fields").alias("gate"), "n")
    again = rows.groupBy(key).count().agg(F.sum((F.col("count") > 1).cast("long")).alias("n")).select(F.lit("repeated_keys").alias("gate"), "n")
    return blank.unionByName(again)


def bibliography(entries: DataFrame) -> DataFrame:
    """key, kind, title, surnames and year of BibTeX entries in a column ``text``."""
    field = lambda name: F.trim(F.regexp_replace(F.regexp_extract("entry", rf"(?is)\b{name}\s*=\s*[{{\"](.*?)[}}\"]\s*,?\s*(?=\n|[a-z]+\s*=|\}}\s*$)", 1), "[{}]", ""))
    each = entries.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?s)@\w+\{.*?\n\}"), F.lit(0))).alias("entry"))
    return each.select(F.regexp_extract("entry", r"@\w+\{([^,]+),", 1).alias("key"), F.lower(F.regexp_extract("entry", r"@(\w+)", 1)).alias("kind"), F.lower(F.regexp_replace(field("title"), r"[^\w\s]", "")).alias("title"), F.transform(F.split(field("author"), r"\s+and\s+"), lambda a: F.lower(F.regexp_extract(a, r"^([^,]+?)(?:,|$)", 1))).alias("surnames"), field("year").alias("year"))


# -- gates of a manuscript -------------------------------------------------------------------------

#: What is dropped from a source before its prose is read: comments, inputs, labels, citations, figures, preamble and lengths. Fixed values.
NOT_PROSE = (r"(?<!\\)%.*", r"\\input\{[^}]+\}", r"\\label\{[^}]+\}", r"\\cite[tp]?\{[^}]+\}", r"\\includegraphics(\[[^\]]*\])?\{[^}]+\}", r"\\(usepackage|documentclass|geometry)(\[[^\]]*\])?\{[^}]+\}", r"\\(vspace|hspace|vskip|hskip)\*?\{[^}]*\}", r"\\\\\[[^\]]*\]")
LITERAL = r"(?<![\w.\\])(\d+(?:\{,\}\d+)*(?:\.\d+)?)(?![\w])"
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand".split()
CLASSES = ("empirical_result", "methodological_assumption", "sample_or_date", "equation_constant", "literature_fact")
EVIDENCE = ("result_id", "macro", "raw_value", "display_value", "unit", "source_artifact")


def prose(text: Column) -> Column:
    for pattern in NOT_PROSE:
        text = F.regexp_replace(text, pattern, "")
    return text


def census_literals(sources: DataFrame) -> DataFrame:
    """literal, n: numbers of the prose in digits, and in words as ``word:<it>``."""
    read = sources.select(prose(F.col("text")).alias("text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![\w-])({'|'.join(NUMBER_WORDS)})(?![\w-])"), F.lit(1))
    found = F.concat(F.regexp_extract_all("text", F.lit(LITERAL), F.lit(1)), F.transform(words, lambda w: F.concat(F.lit("word:"), w)))
    return read.select(F.explode(found).alias("literal")).groupBy("literal").agg(F.count(F.lit(1)).alias("n"))


def macros_used(sources: DataFrame, inventory_rows: DataFrame) -> DataFrame:
    """The registered macros that the prose invokes."""
    used = sources.select(F.explode(F.regexp_extract_all(prose(F.col("text")), F.lit(r"\\([A-Za-z]+)"), F.lit(1))).alias("name")).distinct()
    return used.select(F.concat(F.lit("\\"), "name").alias("macro")).join(inventory_rows.select("macro").distinct(), "macro", "left_semi")


def undefined_macros(sources: DataFrame, inventory_rows: DataFrame) -> DataFrame:
    """Generated names (camelCase) that the prose invokes and no inventory defines."""
    used = sources.select(F.explode(F.regexp_extract_all(prose(F.col("text")), F.lit(r"\\([a-z]+[A-Z][A-Za-z]*)"), F.lit(1))).alias("name")).distinct()
    return used.select(F.concat(F.lit("\\"), "name").alias("macro")).join(inventory_rows.select("macro").distinct(), "macro", "left_anti")


def census_gate(found: DataFrame, census: DataFrame) -> DataFrame:
    """problem, literal: literals outside the census, classes outside the domain, empirical results without their evidence, and those written by hand at all."""
    both = found.select("literal").distinct().join(census.withColumn("known", F.lit(True)), "literal", "left")
    kind = F.trim(F.coalesce("classification", F.lit("")))
    empirical = kind == "empirical_result"
    blank = F.lit(False)
    for c in EVIDENCE:
        blank = blank | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    problems = F.array_compact(F.array(
        F.when(F.col("known").isNull(), "unclassified"), F.when(F.col("known") & ~kind.isin(*CLASSES), "unknown_class"),
        F.when(empirical & blank, "missing_evidence"), F.when(empirical, "empirical_literal"),
    ))
    return both.select(F.explode(problems).alias("problem"), "literal")


def citation_gates(cited: DataFrame, entries: DataFrame, audit: DataFrame) -> DataFrame:
    """problem, key: cited keys without an entry or audit, entries and audits without each other, and verified audits without their evidence. audit: key, status, metadata_verified, supporting_location."""
    missing = lambda name, a, b: a.select("key").distinct().join(b.select("key").distinct(), "key", "left_anti").select(F.lit(name).alias("problem"), "key")
    out = missing("cited_without_entry", cited, entries).unionByName(missing("cited_without_audit", cited, audit)).unionByName(missing("entry_without_audit", entries, audit)).unionByName(missing("audit_without_entry", audit, entries))
    place = F.trim(F.coalesce("supporting_location", F.lit("")))
    problems = F.array_compact(F.array(F.when(F.coalesce("metadata_verified", F.lit("")) != "yes", "metadata_unverified"), F.when(place == "", "no_location"), F.when(place.startswith("TO CHECK"), "claim_unchecked")))
    return out.unionByName(audit.filter("status = 'verified'").select(F.explode(problems).alias("problem"), "key"))


def cited_keys(sources: DataFrame) -> DataFrame:
    groups = sources.select(F.explode(F.regexp_extract_all("text", F.lit(r"\\cite[tp]?\{([^}]+)\}"), F.lit(1))).alias("g"))
    return groups.select(F.explode(F.transform(F.split("g", ","), lambda k: F.trim(k))).alias("key")).filter("key <> ''").distinct()
