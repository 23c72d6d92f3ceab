"""Build, test and mutation logs: parsing and roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import ratio

# The tools' report lines and what each metric is called.
TEST_LINE = r"Tests run: (\d+), Failures: (\d+), Errors: (\d+), Skipped: (\d+)"
TEST_FIELDS = ("tests", "failures", "errors", "skipped")
MUTATION_FIELDS = {
    "line_coverage": r"Line Coverage:\s*([\d.]+)%",
    "mutation_coverage": r"Mutation Coverage:\s*([\d.]+)%",
    "test_strength": r"Test Strength:\s*([\d.]+)%",
    "mutations_generated": r"Generated (\d+) mutations",
    "mutations_killed": r"Killed (\d+)",
    "mutations_survived": r"Survived (\d+)",
}


def test_summary(c: Column) -> dict[str, Column]:
    """Numbers of the last summary line; zeros without one."""
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(f"(?dU){TEST_LINE}"), F.lit(0)), F.lit(-1))
    return {f: F.coalesce(F.regexp_extract(last, f"(?dU){TEST_LINE}", k + 1).try_cast("int"), F.lit(0)) for k, f in enumerate(TEST_FIELDS)}


def mutation_report(c: Column) -> dict[str, Column]:
    """The first hit of each metric as a double; null where a report lacks it."""
    return {f: F.regexp_extract(c, f"(?dU){p}", 1).try_cast("double") for f, p in MUTATION_FIELDS.items()}


def passed(tests: Column, failures: Column, errors: Column) -> Column:
    """Skipped tests count as passed."""
    return tests - failures - errors


def phase_table(commands: DataFrame) -> DataFrame:
    """One row per (version, project) from a command log: compiled, the test numbers where it compiled, and the mutation
    report's where there was one. One pass: of each phase the (one) run's output is picked by group."""
    out = {p: F.max(F.when(F.col("phase") == p, F.col("stdout"))).alias(p) for p in ("test", "mutation")}
    d = commands.groupBy("version", "project").agg(F.max(F.when(F.col("phase") == "compile", F.col("success"))).alias("compiled"), *out.values()).where("compiled is not null")
    tests, mutations = test_summary(F.col("test")), mutation_report(F.col("mutation"))
    tested = F.col("compiled") & F.col("test").isNotNull()
    return d.select("version", "project", "compiled", *[F.when(tested, c).alias(f) for f, c in tests.items()], *[F.when(tested, c).alias(f) for f, c in mutations.items()])


def version_rollup(phases: DataFrame, requested: int) -> DataFrame:
    """Per version: compiled projects, sums of tests, passed tests, pass rate, and the compile rate over all requested projects."""
    p = passed(F.col("tests"), F.col("failures"), F.col("errors"))
    d = phases.groupBy("version").agg(F.sum(F.when(F.col("compiled"), 1).otherwise(0)).alias("compiled"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in TEST_FIELDS], F.coalesce(F.sum(p), F.lit(0)).alias("passed"))
    return d.withColumn("pass_rate", ratio(F.col("passed"), F.col("tests"))).withColumn("compile_rate", ratio(F.col("compiled"), F.lit(requested)))


# Of each version, the folders with its tests and its compiled classes. Callers may pass others.
VERSIONS = {"evosuite": ("src", "target"), "llm": ("llm_oracle", "llm_oracle/target"), "no_oracle": ("no_oracle", "no_oracle/target")}


def version_folders(version: Column, known: dict[str, tuple[str, str]] = VERSIONS) -> Column:
    """struct(test_dir, target_dir); null for versions that are not known, which are skipped."""
    out = F.lit(None).cast("struct<test_dir: string, target_dir: string>")
    for name, (tests, target) in known.items():
        out = F.when(version == name, F.struct(F.lit(tests).alias("test_dir"), F.lit(target).alias("target_dir"))).otherwise(out)
    return out
