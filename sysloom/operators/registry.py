"""Registry metadata signals.

Input: a snapshot table (package_name, status ok/error/missing, latest_version,
version_count, latest_published, weekly_downloads, maintainers).  All signals
are row-local.  The list of popular names is either a pack, compared in the row, or a
table of any size, which is joined on shared deletion variants; the caller chooses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions import packs

DAY_MICROS = 86_400_000_000
MITRE = "T1195.002"
# fixed values: thresholds and points
NEW_DAYS, RECENT_DAYS = 7, 30
FEW_DOWNLOADS, LOW_DOWNLOADS = 100, 1000
MAX_DISTANCE = 2
STRONG_POINTS, MEDIUM_POINTS = 5, 2


def age_days(as_of: Column) -> Column:
    """Whole 24-hour periods since publication, rounded down."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros("latest_published")) / DAY_MICROS).cast("long")


def usable(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status") == "ok")


def age_severity(age: Column) -> Column:
    return F.when(age < NEW_DAYS, "HIGH").when(age < RECENT_DAYS, "MEDIUM")


def package_age(registry: DataFrame, as_of: Column) -> DataFrame:
    age = age_days(as_of)
    return usable(registry).filter(F.col("latest_published").isNotNull()).select(
        "registry_key", age.alias("age_days"), age_severity(age).alias("severity"))


def download_severity(n: Column) -> Column:
    return F.when(n < FEW_DOWNLOADS, "HIGH").when(n < LOW_DOWNLOADS, "LOW")


def low_downloads(registry: DataFrame) -> DataFrame:
    severity = download_severity(F.col("weekly_downloads"))
    return usable(registry).select("registry_key", "weekly_downloads", severity.alias("severity")).filter("severity is not null")


def first_maintainer() -> Column:
    return F.when(F.size("maintainers") > 0, F.coalesce(F.get("maintainers", F.lit(0)), F.lit("?"))).otherwise("unknown")


def single_maintainer(registry: DataFrame) -> DataFrame:
    return usable(registry).filter(F.size("maintainers") <= 1).select(
        "registry_key", first_maintainer().alias("maintainer"), F.lit("LOW").alias("severity"))


def nearest_popular(name: Column, popular: Sequence[str]) -> Column:
    """(distance, target) of the nearest popular name within two edits, or NULL.
    The length band keeps most pairs away from the edit distance."""
    names = F.expr(f"array({fx.sql_list(packs.checked(popular))})")
    near = F.filter(names, lambda p: F.abs(F.length(name) - F.length(p)) <= MAX_DISTANCE)
    scored = F.transform(near, lambda p: F.struct(
        F.levenshtein(F.lower(name), F.lower(p), MAX_DISTANCE).alias("distance"), p.alias("target")))
    # a distance of -1 means more than two edits, 0 the same name in another case
    best = F.array_min(F.filter(scored, lambda s: s["distance"] > 0))
    return F.when(~F.array_contains(names, name), best)


def deletion_variants(name: Column) -> Column:
    """All strings left after removing at most two characters.  Two strings are
    within two edits only if they share such a variant."""
    def shorter(s: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(
            F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
        return F.when(F.length(s) > 0, cut).otherwise(F.array().cast("array<string>"))

    once = shorter(name)
    return F.array_distinct(F.concat(F.array(name), once, F.flatten(F.transform(once, shorter))))


def nearest_in_table(packages: DataFrame, known: DataFrame) -> DataFrame:
    """(package_name, nearest) of the packages that are within two edits of a name in
    ``known``, a table with the column ``name``, and not in it themselves."""
    known = known.filter(F.col("name").isNotNull()).select(F.col("name").alias("target")).distinct()
    names = packages.select("package_name").distinct().join(known, F.col("package_name") == F.col("target"), "left_anti")
    # longer names have no known one within reach, and very many variants
    longest = known.agg(F.max(F.length("target"))).first()[0] or 0
    names = names.filter(F.length("package_name") <= longest + MAX_DISTANCE)
    left = names.select("package_name", F.explode(deletion_variants(F.lower("package_name"))).alias("variant"))
    right = known.select("target", F.explode(deletion_variants(F.lower("target"))).alias("variant"))
    pairs = left.join(right, "variant").select("package_name", "target").distinct()
    distance = F.levenshtein(F.lower("package_name"), F.lower("target"), MAX_DISTANCE)
    near = pairs.withColumn("distance", distance).filter(F.col("distance") > 0)
    return near.groupBy("package_name").agg(F.min(F.struct("distance", "target")).alias("nearest"))


def with_nearest(registry: DataFrame, popular: Sequence[str] | DataFrame) -> DataFrame:
    """``registry`` with ``nearest``, null where the package is not usable or not close to a name."""
    ok = F.col("status") == "ok"
    if isinstance(popular, DataFrame):
        return registry.join(nearest_in_table(usable(registry), popular), "package_name", "left").withColumn("nearest", F.when(ok, F.col("nearest")))
    # a generated column is not computed again where it is used or filtered
    return registry.select("*", fx.once(F.when(ok, nearest_popular(F.col("package_name"), popular))).alias("nearest"))


def typosquat_candidates(registry: DataFrame, popular: Sequence[str] | DataFrame = packs.POPULAR_PACKAGES) -> DataFrame:
    """Packages within two edits of a popular name, with the nearest one
    (ties: alphabetical).  Members of the list itself are never flagged."""
    if isinstance(popular, DataFrame):
        found = usable(registry).join(nearest_in_table(usable(registry), popular), "package_name")
    else:
        found = with_nearest(usable(registry).select("registry_key", "package_name", "status"), popular).filter(F.col("nearest").isNotNull())
    return found.select("registry_key", "package_name", F.col("nearest.target").alias("target"),
                        F.col("nearest.distance").cast("long").alias("distance"))


def not_in_registry(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status") == "error").select("registry_key", "package_name", F.lit("MEDIUM").alias("severity"))


def registry_summary(registry: DataFrame, as_of: Column, popular: Sequence[str] | DataFrame = packs.POPULAR_PACKAGES) -> DataFrame:
    ok = F.col("status") == "ok"
    known = lambda c: F.when(ok, c)
    return with_nearest(registry, popular).select(
        "registry_key", "package_name", ok.alias("available"),
        known(F.coalesce("latest_version", F.lit("unknown"))).alias("latest_version"),
        known(F.col("version_count")).alias("total_versions"),
        known(F.size("maintainers").cast("long")).alias("maintainers"),
        known(F.array_join(F.transform(F.slice("maintainers", 1, 5), lambda m: F.coalesce(m, F.lit("?"))), ",")).alias("maintainer_names"),
        known(age_days(as_of)).alias("age_days"), known(F.col("weekly_downloads")).alias("weekly_downloads"),
        F.col("nearest.target").alias("typosquat_target"))


def metadata_findings(registry: DataFrame, as_of: Column, popular: Sequence[str] | DataFrame = packs.POPULAR_PACKAGES) -> DataFrame:
    """All registry signals as finding rows; ``ordinal`` is the order of the checks.

    One pass: each row builds its (at most five) findings as an array.
    """
    ok, name = F.col("status") == "ok", F.col("package_name")
    age, nearest = age_days(as_of), F.col("nearest")

    def signal(ordinal: int, severity: Column, description: Column, evidence: Column) -> Column:
        return F.when(severity.isNotNull(), F.struct(
            F.lit(ordinal).cast("long").alias("ordinal"), severity.alias("severity"),
            description.alias("description"), evidence.alias("evidence")))

    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    signals = F.array(
        signal(1, F.when(F.col("status") == "error", "MEDIUM"), text("Package '", name, "' is not in the registry"),
               F.lit("Unpublished: private or brand-new")),
        signal(2, F.when(ok, age_severity(age)), text("Latest version published ", age, " days ago"),
               text("Version ", F.coalesce("latest_version", F.lit("unknown")))),
        signal(3, F.when(ok, download_severity(F.col("weekly_downloads"))),
               text("Few downloads: ", F.col("weekly_downloads"), " a week"), F.lit("Well-used packages have 10,000 and more")),
        signal(4, F.when(ok & (F.size("maintainers") <= 1), "LOW"), F.lit("At most one maintainer"),
               text("Maintainer: ", first_maintainer())),
        signal(5, F.when(ok & nearest.isNotNull(), "HIGH"),
               text("Package name '", name, "' is close to '", nearest["target"], "'"),
               text("Levenshtein distance: ", nearest["distance"])),
    )
    rows = with_nearest(registry, popular).select("registry_key", "package_name", F.explode_outer(signals).alias("s")).filter(F.col("s").isNotNull())
    return rows.select("registry_key", "package_name", "s.*", F.lit("suspicious_activity").alias("category"),
                       F.lit(MITRE).alias("mitre_id"), F.lit(packs.MITRE_NAMES[MITRE]).alias("mitre_name"))


def metadata_points(severity: Column) -> Column:
    return (F.when(severity.isin("CRITICAL", "HIGH"), STRONG_POINTS)
            .when(severity == "MEDIUM", MEDIUM_POINTS).otherwise(0))


def merge_metadata(verdicts: DataFrame, signals: DataFrame, recompute_risk: bool = False) -> DataFrame:
    """Add the registry signals of a run's package to its score and finding count.

    As in the original behaviour the risk level keeps the rule engine's value
    unless ``recompute_risk`` is set.  Signals are summed per package first, so
    the join has one row per package on that side and a package with very many
    runs is an ordinary skewed join that adaptive execution splits.
    """
    per_package = signals.groupBy(F.col("registry_key").alias("_key")).agg(
        F.sum(metadata_points(F.col("severity"))).alias("_points"), F.count("*").alias("_signals"))
    name, _ = fx.split_spec("package_name")
    joined = verdicts.withColumn("_key", name).join(per_package, "_key", "left")
    zero = F.lit(0)
    score = F.least(F.col("threat_score") + F.coalesce("_points", zero), F.lit(100)).cast("long")
    merged = joined.withColumn("threat_score", score).withColumn("metadata_findings", F.coalesce("_signals", zero)).withColumn(
        "finding_count", F.col("finding_count") + F.coalesce("_signals", zero))
    if recompute_risk:
        risk = fx.risk_band("threat_score")
        merged = merged.withColumn("risk_level", risk).withColumn("recommendation", fx.recommendation(risk))
    return merged.drop("_key", "_points", "_signals")


def run_metadata_findings(verdicts: DataFrame, signals: DataFrame) -> DataFrame:
    """Registry findings per run.  They follow the sorted rule findings (phase 9)."""
    name, _ = fx.split_spec("package_name")
    runs = verdicts.select("detonation_id", name.alias("registry_key"))
    return runs.join(signals.drop("package_name"), "registry_key").select(
        "detonation_id", "ordinal", "severity", "category", "description", "evidence", "mitre_id", "mitre_name")
