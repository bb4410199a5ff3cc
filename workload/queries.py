"""One callable per query: (spark, table folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.operators.skew import row_numbers, with_next
from tidemark.plans import (
    cohort_average,
    entity_score,
    repair_coded_file,
    repair_text_file,
    table_average,
)
from tidemark.session import shared_dir
from workload.rules import RULES, SMALL

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("string")
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").alias("props100"),
        F.concat(F.lit("w"), week).alias("week"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_returnflag",
        "l_linestatus",
        (F.col("l_quantity").cast("int") - 1).cast("string").alias("qty50"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders")


# --- the named analyses -------------------------------------------------------


def _entity(metric: str, attributes: list[str]) -> Query:
    return lambda spark, d: entity_score(metric, events(spark, d), "user_id", 1, attributes, RULES)


def _average(metric: str, like: str | None, attributes: list[str]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = events(spark, d)
        if like is None:
            out = table_average(metric, rows, "user_id", attributes, RULES)
        else:
            out = cohort_average(metric, rows, "user_id", like, attributes, RULES)
        return out.select(F.round("avg", 10).alias("avg"))

    return query


# --- scores per entity --------------------------------------------------------


def _per_entity(metric: str, source: Callable, key: list[str], attributes: list[str]) -> Query:
    score = {"cvq": tm.cvq, "hsq": tm.hsq}[metric]
    return lambda spark, d: score(source(spark, d), key, attributes, RULES)


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


# --- rule graph ---------------------------------------------------------------


def sequence_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules derived from the data: one attribute per customer, whose values are
    its orders by date; an order is older than the second and third one after it."""
    numbered = row_numbers(
        orders(spark, d).select("o_custkey", "o_orderkey", "o_orderdate"),
        ["o_custkey"],
        [F.col("o_orderdate"), F.col("o_orderkey")],
        "n",
    )
    later = numbered.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("dst"), F.col("n").alias("m"))
    steps = F.explode(F.array(F.lit(2), F.lit(3)))
    return (
        numbered.select("o_custkey", "o_orderkey", "n", steps.alias("step"))
        .join(later, (F.col("o_custkey") == F.col("cust")) & (F.col("n") + F.col("step") == F.col("m")))
        .select(
            F.col("o_custkey").cast("string").alias("attribute"),
            F.col("o_orderkey").cast("string").alias("src"),
            F.col("dst").cast("string").alias("dst"),
        )
    )


def order_rules(spark: SparkSession, d: str) -> DataFrame:
    """The same steps as rules of one attribute, the order key."""
    return sequence_rules(spark, d).withColumn("attribute", F.lit("o_orderkey"))


def day_rules(spark: SparkSession, d: str) -> DataFrame:
    """Days of the year on which there are orders: one is older than those up to 40 days later."""
    days = orders(spark, d).select(F.dayofyear("o_orderdate").alias("day")).distinct()
    later = days.select(F.explode(F.sequence(F.col("day") - 40, F.col("day") - 1)).alias("day"), F.col("day").alias("to"))
    status = tm.load_rules(spark, {"o_orderstatus": SMALL["o_orderstatus"]}).select("attribute", "src", "dst")
    return status.unionByName(
        days.join(later, "day").select(
            F.lit("yearday").alias("attribute"), F.col("day").cast("string").alias("src"), F.col("to").cast("string").alias("dst")
        )
    )


def rule_closure(spark: SparkSession, d: str) -> DataFrame:
    return tm.rule_closure(sequence_rules(spark, d), spark)


def rule_rank(spark: SparkSession, d: str) -> DataFrame:
    return tm.rule_rank(sequence_rules(spark, d), spark)


def rule_edges(spark: SparkSession, d: str) -> DataFrame:
    return tm.rule_edges(sequence_rules(spark, d))


def rules_from_csv(spark: SparkSession, d: str) -> DataFrame:
    """Rules written to a file and loaded from it, with a monotone row that orders nothing."""
    monotone = tm.load_rules(spark, {}, {"o_totalprice": ("low", "high")})
    rules = sequence_rules(spark, d).withColumn("kind", F.lit(None).cast("string")).unionByName(monotone)
    path = f"{shared_dir(spark)}/csv-{uuid4().hex}"
    tm.save_table(rules, path)
    return tm.rule_rank(tm.load_rules(spark, path), spark)


def value_relation(spark: SparkSession, d: str) -> DataFrame:
    pairs = with_next(
        orders(spark, d).select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"),
        ["o_custkey"],
        [F.col("o_orderdate"), F.col("o_orderkey")],
        {"o_orderkey": "next_orderkey", "o_orderpriority": "next_priority"},
    ).filter(F.col("next_orderkey").isNotNull())
    related = tm.relation(pairs, "o_orderpriority", "next_priority", "o_orderpriority", RULES)
    return related.select("o_orderkey", "next_orderkey", "o_orderpriority", "next_priority", "relation")


# --- histograms and pruned graphs ---------------------------------------------

EVENT_ATTRIBUTES = ["event_type", "props100"]


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return tm.value_counts(events(spark, d), ["user_id"], EVENT_ATTRIBUTES, "event_id")


def value_versions(spark: SparkSession, d: str) -> DataFrame:
    return tm.value_versions(events(spark, d), ["user_id"], EVENT_ATTRIBUTES, "event_id")


def latest_values(spark: SparkSession, d: str) -> DataFrame:
    return tm.latest_values(lines(spark, d), ["l_partkey"], ["qty50", "l_returnflag"], RULES)


def present_edges(spark: SparkSession, d: str) -> DataFrame:
    return tm.present_edges(events(spark, d), ["user_id"], EVENT_ATTRIBUTES, RULES)


# --- more rules than the driver compiles ---------------------------------------


def _finished(spark: SparkSession, d: str) -> DataFrame:
    """All orders; an order that is not finished has no value yet."""
    finished = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    return orders(spark, d).select("o_custkey", finished.alias("o_orderkey"))


def _sequence(function: Callable) -> Query:
    return lambda spark, d: function(_finished(spark, d), ["o_custkey"], ["o_orderkey"], order_rules(spark, d))


def _yeardays(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select(
        "o_custkey", "o_orderkey", "o_orderstatus", F.dayofyear("o_orderdate").cast("string").alias("yearday")
    )


DAY_REPAIR = (["o_custkey"], "o_orderkey", "o_orderstatus", "yearday")


def repair_sequence(spark: SparkSession, d: str) -> DataFrame:
    return tm.repair(_yeardays(spark, d), *DAY_REPAIR, day_rules(spark, d))


def detect_sequence(spark: SparkSession, d: str) -> DataFrame:
    return tm.detect_errors(_yeardays(spark, d), *DAY_REPAIR, day_rules(spark, d))


def rank_sequence(spark: SparkSession, d: str) -> DataFrame:
    return tm.static_rank(_yeardays(spark, d), "yearday", day_rules(spark, d), "sort_id")


# --- ordering, detection, repair ----------------------------------------------

ORDER_KEYS = ["o_custkey"]
ORDER_REPAIR = (ORDER_KEYS, "o_orderkey", "o_orderpriority", "o_orderstatus", RULES)
EVENT_REPAIR = (["user_id"], "event_id", "week", "event_type", RULES)


def _slim_orders(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")


def static_rank(spark: SparkSession, d: str) -> DataFrame:
    out = tm.static_rank(_slim_orders(spark, d), "o_orderpriority", RULES, "group_id")
    return tm.static_rank(out, "o_orderstatus", RULES, "sort_id")


def topo_dense_rank(spark: SparkSession, d: str) -> DataFrame:
    return tm.dense_topo_rank(_slim_orders(spark, d), ORDER_KEYS, "o_orderpriority", RULES, "o_orderkey")


def topo_row_number(spark: SparkSession, d: str) -> DataFrame:
    # ranking by customer first: its partitioning serves the numbering too
    ranked = tm.dense_topo_rank(_slim_orders(spark, d), ORDER_KEYS, "o_orderpriority", RULES, "o_orderkey")
    return tm.topo_row_number(
        ranked, [*ORDER_KEYS, "o_orderpriority"], "o_orderstatus", RULES, "o_orderkey"
    )


def run_compress(spark: SparkSession, d: str) -> DataFrame:
    return tm.run_compress(_slim_orders(spark, d), *ORDER_REPAIR)


def detect_errors(spark: SparkSession, d: str) -> DataFrame:
    return tm.detect_errors(_slim_orders(spark, d), *ORDER_REPAIR)


def detect_event_errors(spark: SparkSession, d: str) -> DataFrame:
    return tm.detect_errors(events(spark, d), *EVENT_REPAIR)


def repair_status(spark: SparkSession, d: str) -> DataFrame:
    return tm.repair(orders(spark, d), *ORDER_REPAIR)


def repair_compressed(spark: SparkSession, d: str) -> DataFrame:
    return tm.repair(orders(spark, d), *ORDER_REPAIR, compress_runs=True)


def repair_events(spark: SparkSession, d: str) -> DataFrame:
    return tm.repair(events(spark, d), *EVENT_REPAIR)


def repair_join_back(spark: SparkSession, d: str) -> DataFrame:
    base = orders(spark, d)
    cells = tm.repaired_cells(base, *ORDER_REPAIR, compress_runs=True)
    return tm.join_back(base, cells, ORDER_KEYS, "o_orderkey", "o_orderstatus")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    """Orders with unknown and missing values: each rule leaves one value out, and one is null."""
    return orders(spark, d).select(
        "o_custkey",
        "o_orderkey",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("gap_status"),
        F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH")).alias("gap_priority"),
    )


GAP_REPAIR = (ORDER_KEYS, "o_orderkey", "gap_status", "gap_priority", RULES)


def repair_gaps(spark: SparkSession, d: str) -> DataFrame:
    return tm.repair(_gaps(spark, d), *GAP_REPAIR)


def repair_gaps_compressed(spark: SparkSession, d: str) -> DataFrame:
    return tm.repair(_gaps(spark, d), *GAP_REPAIR, compress_runs=True)


def detect_gaps(spark: SparkSession, d: str) -> DataFrame:
    return tm.detect_errors(_gaps(spark, d), *GAP_REPAIR)


def runs_gaps(spark: SparkSession, d: str) -> DataFrame:
    return tm.run_compress(_gaps(spark, d), *GAP_REPAIR)


def detect_by_value(spark: SparkSession, d: str) -> DataFrame:
    """Errors among the events of equal size, which the table calls ``value``."""
    sized = events(spark, d).join(
        table(spark, d, "events").select("event_id", F.floor("value").cast("bigint").alias("value")), "event_id"
    )
    return tm.detect_errors(
        sized, ["value"], "event_id", "week", "event_type", RULES, names=("next_id", "type", "next_type")
    )


def score_view_sql(spark: SparkSession, d: str) -> DataFrame:
    """Scores as a view, queried with SQL."""
    tm.register(tm.cvq(events(spark, d), ["user_id"], EVENT_ATTRIBUTES, RULES), "user_scores")
    return spark.sql(
        """SELECT round(avg(score), 10) AS avg, count(*) AS users FROM (
             SELECT user_id, (event_type_cvq + props100_cvq) / 2 AS score FROM user_scores)"""
    )


def hsq_sql(spark: SparkSession, d: str) -> DataFrame:
    """History scores by SQL aggregates."""
    tm.register(events(spark, d), "sql_events")
    tm.register_scores(spark, RULES, EVENT_ATTRIBUTES)
    score = "hsq('{0}', collect_set(ruled('{0}', {0})), count(DISTINCT unruled('{0}', {0}))) AS {0}_hsq"
    columns = ", ".join(score.format(a) for a in EVENT_ATTRIBUTES)
    return spark.sql(f"SELECT user_id, {columns} FROM sql_events GROUP BY user_id")


def cvq_sql(spark: SparkSession, d: str) -> DataFrame:
    """Latest-value scores by SQL aggregates over a histogram, which SQL counts too."""
    tm.register(lines(spark, d), "sql_lines")
    tm.register_scores(spark, RULES, ["qty50"])
    return spark.sql(
        """SELECT l_partkey,
             cvq('qty50', collect_list(ruled_cell('qty50', value, n)), min(unruled_count('qty50', value, n)),
                 sum(unruled_count('qty50', value, n))) AS qty50_cvq
           FROM (SELECT l_partkey, qty50 AS value, count(*) AS n FROM sql_lines GROUP BY ALL)
           GROUP BY l_partkey"""
    )


def _merged(score: Callable) -> Query:
    """Scores from the kept histogram of one part of the events and that of the rest."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = events(spark, d).withColumn("late", F.col("week") >= "w2")
        old, new = (tm.histogram(rows.filter(part), ["user_id"], EVENT_ATTRIBUTES) for part in ("not late", "late"))
        merged = tm.merge_histograms(["user_id"], old, new)
        return score(merged, ["user_id"], EVENT_ATTRIBUTES, RULES)

    return query


def preview_score(spark: SparkSession, d: str) -> DataFrame:
    """The first row of a result that has one."""
    return tm.preview(tm.cvq(lines(spark, d), [], ["qty50", "l_returnflag"], RULES))


def relation_sequence(spark: SparkSession, d: str) -> DataFrame:
    """How a customer's neighbours in key order stand to one another, under rules that follow dates."""
    pairs = with_next(
        orders(spark, d).select("o_custkey", "o_orderkey"),
        ["o_custkey"],
        [F.col("o_orderkey")],
        {"o_orderkey": "next_orderkey"},
    ).filter(F.col("next_orderkey").isNotNull())
    return tm.relation(pairs, "o_orderkey", "next_orderkey", "o_orderkey", order_rules(spark, d))


def repair_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Repair of a table bucketed by row key; neither it nor the join back shuffles the wide rows."""
    keys = [*ORDER_KEYS, "o_orderkey"]
    mark = uuid4().hex
    base = tm.save_bucketed(orders(spark, d), f"orders_{mark}", keys, 8, f"{shared_dir(spark)}/bucketed-{mark}")
    cells = tm.repaired_cells(base, *ORDER_REPAIR)
    return tm.join_back(base, cells, ORDER_KEYS, "o_orderkey", "o_orderstatus")


def csv_sized(spark: SparkSession, d: str) -> DataFrame:
    """CSV files of about 200 kB, written over the table they come from."""
    rows = _slim_orders(spark, d)
    path = f"{shared_dir(spark)}/csv-{uuid4().hex}"
    tm.save_table(rows, path)
    tm.save_table(tm.load_table(spark, path, rows.schema), path, file_bytes=200_000)
    return tm.load_table(spark, path, rows.schema)


def csv_text_scan(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/csv-{uuid4().hex}"
    tm.save_table(_slim_orders(spark, d), path)
    return tm.load_table(spark, path)


def _job(spark: SparkSession, d: str, job: Callable, *schema) -> str:
    source, target = (f"{shared_dir(spark)}/csv-{uuid4().hex}" for _ in range(2))
    tm.save_table(_slim_orders(spark, d), source)
    job(
        spark, source, target, *schema, "o_orderpriority", "o_orderstatus", RULES, key="o_custkey", vid="o_orderkey"
    )
    return target


def repair_text_job(spark: SparkSession, d: str) -> DataFrame:
    return tm.load_table(spark, _job(spark, d, repair_text_file))


def repair_coded_job(spark: SparkSession, d: str) -> DataFrame:
    schema = _slim_orders(spark, d).schema
    return tm.load_table(spark, _job(spark, d, repair_coded_file, schema), schema)


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = _slim_orders(spark, d)
    path = f"{shared_dir(spark)}/csv-{uuid4().hex}"
    tm.save_table(tm.repair(rows, *ORDER_REPAIR), path, files=8)
    return tm.load_table(spark, path, rows.schema)


QUERIES: dict[str, Query] = {
    "cvq_entity": _entity("cvq", ["event_type"]),
    "cvq_entity_multi": _entity("cvq", EVENT_ATTRIBUTES),
    "cvq_cohort_avg": _average("cvq", "1_", EVENT_ATTRIBUTES),
    "cvq_db_avg": _average("cvq", None, EVENT_ATTRIBUTES),
    "hsq_entity": _entity("hsq", ["event_type"]),
    "hsq_entity_multi": _entity("hsq", EVENT_ATTRIBUTES),
    "hsq_cohort_avg": _average("hsq", "1_", EVENT_ATTRIBUTES),
    "hsq_db_avg": _average("hsq", None, EVENT_ATTRIBUTES),
    "cvq_per_entity": _per_entity("cvq", events, ["user_id"], EVENT_ATTRIBUTES),
    "hsq_per_entity": _per_entity("hsq", events, ["user_id"], EVENT_ATTRIBUTES),
    "cvq_whole_table": _per_entity("cvq", lines, [], ["qty50", "l_returnflag"]),
    "hsq_whole_table": _per_entity("hsq", lines, [], ["qty50", "l_returnflag"]),
    "cvq_orders": _per_entity("cvq", orders, ["o_custkey"], ["o_orderpriority", "o_orderstatus"]),
    "hsq_orders": _per_entity("hsq", orders, ["o_custkey"], ["o_orderpriority", "o_orderstatus"]),
    "cvq_parts": _per_entity("cvq", lines, ["l_partkey"], ["qty50"]),
    "hsq_parts": _per_entity("hsq", lines, ["l_partkey"], ["qty50"]),
    "cvq_lines": _per_entity("cvq", lines, ["l_orderkey"], ["l_returnflag", "l_linestatus"]),
    "hsq_lines": _per_entity("hsq", lines, ["l_orderkey"], ["l_returnflag", "l_linestatus"]),
    "cvq_no_rules": _per_entity("cvq", _customers, ["c_nationkey"], ["c_mktsegment"]),
    "hsq_no_rules": _per_entity("hsq", _customers, ["c_nationkey"], ["c_mktsegment"]),
    "cvq_roles": _per_entity("cvq", _turns, ["conv_id"], ["role"]),
    "hsq_roles": _per_entity("hsq", _turns, ["conv_id"], ["role"]),
    "rule_edges": rule_edges,
    "rule_closure": rule_closure,
    "rule_rank": rule_rank,
    "value_relation": value_relation,
    "value_counts": value_counts,
    "value_versions": value_versions,
    "latest_values": latest_values,
    "present_edges": present_edges,
    "static_rank": static_rank,
    "topo_dense_rank": topo_dense_rank,
    "topo_row_number": topo_row_number,
    "run_compress": run_compress,
    "detect_errors": detect_errors,
    "detect_event_errors": detect_event_errors,
    "repair_status": repair_status,
    "repair_compressed": repair_compressed,
    "repair_events": repair_events,
    "repair_join_back": repair_join_back,
    "csv_round_trip": csv_round_trip,
    "cvq_sequence": _sequence(tm.cvq),
    "hsq_sequence": _sequence(tm.hsq),
    "latest_sequence": _sequence(tm.latest_values),
    "present_edges_sequence": _sequence(tm.present_edges),
    "repair_sequence": repair_sequence,
    "detect_sequence": detect_sequence,
    "rank_sequence": rank_sequence,
    "repair_gaps": repair_gaps,
    "repair_gaps_compressed": repair_gaps_compressed,
    "detect_gaps": detect_gaps,
    "runs_gaps": runs_gaps,
    "detect_by_value": detect_by_value,
    "repair_bucketed": repair_bucketed,
    "csv_sized": csv_sized,
    "relation_sequence": relation_sequence,
    "hsq_sql": hsq_sql,
    "cvq_sql": cvq_sql,
    "cvq_merged": _merged(tm.cvq_of),
    "hsq_merged": _merged(tm.hsq_of),
    "preview_score": preview_score,
    "score_view_sql": score_view_sql,
    "rules_from_csv": rules_from_csv,
    "csv_text_scan": csv_text_scan,
    "repair_text_job": repair_text_job,
    "repair_coded_job": repair_coded_job,
}
