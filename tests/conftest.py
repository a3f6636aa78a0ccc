import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare():
    """Rows of a frame and of SQL over the given tables, made alike and sorted."""
    import duckdb

    def norm(rows):
        show = lambda v: f"{v:.9g}" if isinstance(v, float) else "null" if v is None or v != v else str(v)
        return sorted(tuple(map(show, r)) for r in rows)

    def run(df, sql, sf_dir):
        con = duckdb.connect()
        for name in os.listdir(sf_dir):
            con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}{'/*.parquet' if os.path.isdir(os.path.join(sf_dir, name)) else ''}'")
        cols = sorted(df.columns)
        ours, theirs = df.select(cols).toPandas(), con.sql(sql).df()
        assert sorted(theirs.columns) == cols
        return norm(ours.itertuples(index=False, name=None)), norm(theirs[cols].itertuples(index=False, name=None))

    return run
