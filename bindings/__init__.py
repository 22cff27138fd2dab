"""Queries that run each operator over the driver tables, each with an SQL oracle where SQL can
tell. Input frames are SQL texts both engines read, so an operator and its oracle start alike."""

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TODAY = "2000-06-30"

QUERIES = {}
ORACLES = {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark, sf_dir, sql):
    """An input frame: the SQL over the driver tables it names in braces."""
    used = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql):
    for n in TABLES:
        sql = sql.replace("{" + n + "}", n)
    return sql


def register(name, frames, run, oracle=None):
    """``frames`` name -> SQL become keyword arguments of ``run``; the oracle reads them by name.
    An oracle that starts with a comma goes on with further WITH items."""
    def query(spark, sf_dir):
        return run(**{n: frame(spark, sf_dir, q) for n, q in frames.items()})
    QUERIES[name] = query
    if oracle is not None:
        ctes = ", ".join(f"{n} AS ({duck(q)})" for n, q in frames.items())
        oracle = duck(oracle.strip())
        ORACLES[name] = f"WITH {ctes} {oracle}" if ctes else oracle
