"""From raw findings to an inventory: normalisation, stable order, split, checks, redaction and summary."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keys as K
from ..shared import written


@dataclass(frozen=True)
class Inventory:
    """Frames of one or more scans, told apart by ``scan_id``."""

    items: DataFrame
    uncertain: DataFrame
    checks: DataFrame
    diagnostics: DataFrame
    summary: DataFrame | None = None
    project: dict[str, str] = field(default_factory=dict)


def normalize(findings: DataFrame) -> DataFrame:
    """Fills ``normalized_key`` and the defaults of role, confidence and details."""
    config = F.col("kind") == "CONFIG"
    return findings.withColumns({
        "normalized_key": F.when(config, K.normalize_key("key")),
        "role": F.when(config, F.coalesce("role", F.lit("READ"))),
        "confidence": F.coalesce("confidence", F.when(config, "MEDIUM").otherwise("LOW")),
    })


def with_hints(findings: DataFrame, profile: str | None = None, region: str | None = None, namespace: str | None = None) -> DataFrame:
    """Environment dimensions that a finding leaves open take the hints."""
    parts = [F.coalesce(F.col(f"environment.{n}"), F.lit(h).cast("string")).alias(n) for n, h in (("profile", profile), ("region", region), ("namespace", namespace))]
    return findings.withColumn("environment", F.struct(*parts))


def order_columns(tie: Column | str = "emit_seq") -> list[Column]:
    return [F.col("source.path").asc(), F.col("source.line").asc_nulls_last(), F.col("environment.profile").asc_nulls_last(),
            F.col("detector_id").asc(), F.coalesce("key", "expression").asc(), F.col(tie).asc() if isinstance(tie, str) else tie.asc()]


def placed(frame: DataFrame, *order: Column | str, by: str | None = None, place: str = "place") -> DataFrame:
    """``frame`` with the place of every row in the given order, from 1; within the rows of equal ``by``, if given.

    One value of ``by`` may hold most rows, so the place is not a window over them: rows are numbered by one range sort,
    written once since the numbers must not change when read again, and become places by the counts of earlier
    partitions.  Nulls stand first unless the order says otherwise.
    """
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    own = [] if by is None else [F.col(by)]
    ranged = frame.repartitionByRange(*own, *columns).sortWithinPartitions(*own, *columns)
    numbered = written(ranged.withColumn("_gid", F.monotonically_increasing_id()), "places").withColumns({"_part": F.shiftrightunsigned("_gid", 33), "_by": own[0] if own else F.lit(0)})
    counts = numbered.groupBy("_by", "_part").agg(F.count("*").alias("_n"), F.min("_gid").alias("_least"))
    earlier = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_by", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_least") + 1).alias("_shift"))
    left, right = numbered.alias("l"), base.alias("r")
    on = F.col("l._by").eqNullSafe(F.col("r._by")) & (F.col("l._part") == F.col("r._part"))
    return left.join(right, on).select(*[F.col(f"l.{c}") for c in frame.columns if c != place], (F.col("_gid") + F.col("_shift")).alias(place))


def with_ordinal(findings: DataFrame, tie: str = "emit_seq") -> DataFrame:
    """``ordinal``: the stable place of every finding in its scan, from 1."""
    return placed(findings, *order_columns(tie), by="scan_id", place="ordinal")


def split(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return findings.where("kind = 'CONFIG'"), findings.where("kind = 'UNCERTAIN'")


def _check(kind: str, severity: str, message: Column, key: Column) -> list[Column]:
    return [F.col("scan_id"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), message.alias("message"), key.alias("key"), F.col("source")]


def _key_or_raw() -> Column:
    return F.coalesce("normalized_key", "key")


def sensitive_checks(items: DataFrame, message: str = "Configuration key name looks sensitive: ") -> DataFrame:
    return items.where(K.is_sensitive(_key_or_raw())).select(*_check("sensitive-looking-key", "WARNING", F.concat(F.lit(message), "key"), F.col("key")))


def remote_checks(items: DataFrame) -> DataFrame:
    hit = K.is_remote("normalized_key", F.col("value.raw"), F.col("details.type"))
    return items.where(hit).select(*_check("remote-config-source", "WARNING", F.concat(F.lit("Remote config center reference needs external inventory review: "), "key"), F.col("key")))


def uncertain_message(prefix: str) -> Column:
    sink = F.when(F.trim(F.coalesce("root_sink", F.lit(""))) == "", "unknown sink").otherwise(F.col("root_sink"))
    return F.concat(F.lit(prefix), F.coalesce("reason", F.lit("null")), F.lit(" via "), sink, F.lit(": "), F.col("expression"))


def uncertain_checks(uncertain: DataFrame, prefix: str = "Dynamic configuration key requires review: ") -> DataFrame:
    return uncertain.select(*_check("dynamic-config-key", "ERROR", uncertain_message(prefix), F.lit(None).cast("string")))


def redact(items: DataFrame, mask: str = K.MASK) -> DataFrame:
    """Values and details of facts with sensitive keys are masked; their type tags stay."""
    hit, m = K.is_sensitive(_key_or_raw()), F.lit(mask)

    def masked(c: str) -> Column:
        return F.when(hit & F.col(c).isNotNull(), F.struct(m.alias("raw"), m.alias("normalized"), F.col(f"{c}.type").alias("type"))).otherwise(F.col(c))

    kind = F.col("details.type")
    given = F.col("details.default_value").isNotNull()
    details = F.col("details")
    details = details.withField("default_value", F.when((kind == "spring-placeholder") | (kind.isin("java-system-property", "config-center") & given), m).otherwise(F.col("details.default_value")))
    details = details.withField("raw_expression", F.when(kind == "spring-placeholder", m).otherwise(F.col("details.raw_expression")))
    details = details.withField("raw_text", F.when(kind == "unknown", m).otherwise(F.col("details.raw_text")))
    details = details.withField("payload", F.when(kind == "external", m).otherwise(F.col("details.payload")))
    return items.withColumns({"value": masked("value"), "default_value": masked("default_value"), "details": F.when(hit & details.isNotNull(), details).otherwise(F.col("details"))})


def summarize(inventory: Inventory) -> DataFrame:
    """One row per scan: distinct keys, findings, uncertain accesses, checks, diagnostics.  One pass, one shuffle."""
    def part(frame: DataFrame, name: str, key: Column) -> DataFrame:
        return frame.select("scan_id", F.lit(name).alias("part"), key.alias("k"))

    none = F.lit(None).cast("string")
    rows = reduce(DataFrame.unionByName, [
        part(inventory.items, "findings", F.col("normalized_key")), part(inventory.uncertain, "uncertain", none),
        part(inventory.checks, "checks", none), part(inventory.diagnostics, "diagnostics", none)])
    return rows.groupBy("scan_id").agg(
        F.count_distinct("k").alias("keys"), *[F.count_if(F.col("part") == n).alias(n) for n in ("findings", "uncertain", "checks", "diagnostics")])


def assemble(findings: DataFrame, diagnostics: DataFrame, project: dict[str, str] | None = None) -> Inventory:
    """The inventory of normalised, ordered findings, split by kind; enrichers add the rest."""
    items, uncertain = split(findings)
    return Inventory(items, uncertain, sensitive_checks(items.where(F.lit(False))), diagnostics, None, {"name": "unknown", "ref": "unknown"} | (project or {}))


def with_redaction(inv: Inventory) -> Inventory:
    return replace(inv, items=redact(inv.items))


def with_sensitive_checks(inv: Inventory) -> Inventory:
    return replace(inv, checks=inv.checks.unionByName(sensitive_checks(inv.items)))


def with_remote_checks(inv: Inventory) -> Inventory:
    return replace(inv, checks=inv.checks.unionByName(remote_checks(inv.items)))


def with_uncertain_checks(inv: Inventory) -> Inventory:
    return replace(inv, checks=inv.checks.unionByName(uncertain_checks(inv.uncertain)))


def with_summary(inv: Inventory) -> Inventory:
    return replace(inv, summary=summarize(inv))


#: What is added to an inventory, in this order; redaction comes first where it is asked for.
ENRICHERS = (with_sensitive_checks, with_remote_checks, with_uncertain_checks, with_summary)


def build(findings: DataFrame, diagnostics: DataFrame, redacted: bool = False, project: dict[str, str] | None = None) -> Inventory:
    """The inventory of normalised, ordered findings with redaction, if asked for, checks and summary."""
    inv = assemble(findings, diagnostics, project)
    return reduce(lambda i, f: f(i), [*([with_redaction] if redacted else []), *ENRICHERS], inv)
