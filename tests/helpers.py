"""Small helpers shared by the tests."""

from collections import Counter


def rows(df):
    return [tuple(r) for r in df.collect()]


def bag(df):
    """Rows as a multiset, columns in the order of their names."""
    def plain(value):
        return tuple(value) if isinstance(value, list) else value

    ordered = df.select(*sorted(df.columns))
    return Counter(tuple(plain(v) for v in r) for r in ordered.collect())


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The adaptive plan after it ran."""
    df.collect()
    return physical_plan(df).split("== Initial Plan ==")[0]


def jobs_started(spark, build):
    """Number of Spark jobs that start while ``build`` runs."""
    context = spark.sparkContext
    context.setJobGroup("count-jobs", "jobs started while a plan is built")
    try:
        result = build()
        return len(context.statusTracker().getJobIdsForGroup("count-jobs")), result
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
