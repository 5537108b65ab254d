"""Two small tables with NULLs and a manager reference."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

#: The rows the reference queries are written for.
DEPT = [(1, "Engineering", 500000), (2, "Sales", 200000), (3, "Research", 350000), (4, "Legal", None)]
EMP = [
    (1, "Ada", 1, 185000, "2019-03-04", None), (2, "Grace", 1, 172000, "2020-07-15", 1), (3, "Linus", 1, 140000, "2022-01-10", 1), (4, "Ken", 2, 98000, "2018-11-01", None),
    (5, "Barbara", 2, 105000, "2021-05-20", 4), (6, "Edsger", 3, 160000, "2017-09-12", None), (7, "Margaret", None, 120000, "2023-02-28", None),
]


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    emp = [(*r[:4], datetime.date.fromisoformat(r[4]), r[5]) for r in EMP]
    return {
        "dept": spark.createDataFrame(DEPT, "id long, name string, budget long"),
        "emp": spark.createDataFrame(emp, "id long, name string, dept_id long, salary long, hired date, manager_id long"),
    }
