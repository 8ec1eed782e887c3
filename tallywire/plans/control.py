"""Queries over the tree of configuration and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywire.functions.scalars import number_or_zero, path_of, path_parts
from tallywire.operators import monitor as M
from tallywire.operators import server as V
from tallywire.operators import tree as O
from tallywire.plans.register import query
from tallywire.sources.text import flatten_xml, to_xml
from tallywire.sources.views import TREE, table, tree


@query(f"WITH {TREE} SELECT path, s_suppkey, value FROM tree WHERE regexp_matches(path, 'ASIA.*Balance$')")
def tree_search(spark, sf_dir):
    return O.search(tree(spark, sf_dir), "ASIA.*Balance$").select("path", "s_suppkey", "value")


@query(f"WITH {TREE} SELECT path, s_suppkey, value FROM tree WHERE name IN ('Name', 'Key')")
def status_list(spark, sf_dir):
    """A fixed list of variables."""
    return tree(spark, sf_dir).filter(F.col("name").isin("Name", "Key")).select("path", "s_suppkey", "value")


@query(f"WITH {TREE} SELECT path, s_suppkey, value FROM tree ORDER BY path, s_suppkey")
def ordered_paths(spark, sf_dir):
    return tree(spark, sf_dir).select("path", "s_suppkey", "value").orderBy("path", "s_suppkey")


SETTINGS = "settings AS (SELECT * FROM (VALUES ('Name', NULL, 'all'), ('Name', 2, 'second'), ('Absent', NULL, 'x')) t(name, idx, value))"


def _settings(spark):
    return spark.createDataFrame([("Name", None, "all"), ("Name", 2, "second"), ("Absent", None, "x")], "name string, idx int, value string")


@query(f"WITH {TREE} SELECT path, s_suppkey, CASE WHEN idx = 2 THEN 'second' ELSE 'all' END AS new_value FROM tree WHERE name = 'Name'")
def config_fanout(spark, sf_dir):
    return O.assign(tree(spark, sf_dir), _settings(spark)).select("path", "s_suppkey", "new_value")


@query(f"WITH {SETTINGS} SELECT name, value FROM settings WHERE name = 'Absent'")
def config_unknown(spark, sf_dir):
    return O.unknown_settings(tree(spark, sf_dir), _settings(spark)).select("name", "value")


@query(f"WITH {TREE} SELECT path, s_suppkey FROM tree JOIN (VALUES ('Balance', NULL), ('Key', 3)) c(name, i) ON tree.name = c.name AND tree.idx = coalesce(c.i, 0)")
def command_dispatch(spark, sf_dir):
    """Commands reach the instance they name, the first one if they name none."""
    commands = F.broadcast(spark.createDataFrame([("Balance", None), ("Key", 3)], "name string, i int"))  # a user's commands
    rows = tree(spark, sf_dir)
    return rows.join(commands, (rows["name"] == commands["name"]) & (rows["idx"] == F.coalesce(commands["i"], F.lit(0)))).select("path", "s_suppkey")


@query(f"WITH {TREE} SELECT path || ':Link' AS path, path AS target, value, s_suppkey FROM tree WHERE name = 'Key'")
def variable_links(spark, sf_dir):
    rows = tree(spark, sf_dir)
    links = rows.filter("name = 'Key'").select(F.concat("path", F.lit(":Link")).alias("path"), F.col("path").alias("target")).distinct()
    return O.linked(rows, links)


@query(f"WITH {TREE} SELECT path, s_suppkey FROM tree WHERE host NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0)")
def enabled_subtrees(spark, sf_dir):
    off = table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("host"))
    return O.enabled(tree(spark, sf_dir), off).select("path", "s_suppkey")


@query(f"WITH {TREE} SELECT path, s_suppkey, kind FROM tree WHERE kind = 'config' OR (kind = 'status' AND idx <> 1)")
def visible_leaves(spark, sf_dir):
    """What is written out: configuration, and status that is not hidden for its instance."""
    return tree(spark, sf_dir).filter("kind = 'config' or (kind = 'status' and idx <> 1)").select("path", "s_suppkey", "kind")


@query(f"WITH {TREE} SELECT path, s_suppkey, depth, split_part(part, '(', 1) AS name, TRY_CAST(nullif(regexp_extract(part, '\\((\\d+)\\)$', 1), '') AS INTEGER) AS idx FROM (SELECT path, s_suppkey, unnest(string_split(path, ':')) AS part, generate_subscripts(string_split(path, ':'), 1) - 1 AS depth FROM tree)")
def path_levels(spark, sf_dir):
    return O.levels(tree(spark, sf_dir)).withColumn("depth", F.col("depth").cast("long"))


@query(f"WITH {TREE} SELECT host, count(*) AS leaves, count(DISTINCT idx) AS instances FROM tree GROUP BY host")
def device_counts(spark, sf_dir):
    return tree(spark, sf_dir).groupBy("host").agg(F.count(F.lit(1)).alias("leaves"), F.countDistinct("idx").alias("instances"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE n = 1 OR event_type IS DISTINCT FROM p""")
def compact_status(spark, sf_dir):
    return M.changed(table(spark, sf_dir, "events"), key="user_id", order=("ts", "event_id"), value="event_type").select("user_id", "event_id", "event_type")


@query("SELECT c_custkey AS address, v AS expected, g AS got FROM (SELECT c_custkey, c_custkey * 257 AS v, c_custkey * 257 + CASE WHEN c_custkey % 11 = 0 THEN 16 WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS g FROM customer) WHERE (v & 240) <> (g & 240)")
def register_verify(spark, sf_dir):
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    expected = rows.select(key.alias("address"), (key * 257).alias("value"), F.lit(240).cast("long").alias("mask"))
    got = rows.select(key.alias("address"), (key * 257 + F.when(key % 11 == 0, 16).when(key % 13 == 0, 1).otherwise(0)).alias("value"))
    return O.verify(expected, got).select("address", "expected", "got")


@query("SELECT c_custkey AS address, c_custkey * 257 AS value FROM customer WHERE c_custkey BETWEEN 16 AND 47")
def register_scan(spark, sf_dir):
    """A range of mapped memory."""
    return table(spark, sf_dir, "customer").filter("c_custkey between 16 and 47").select(F.col("c_custkey").alias("address"), (F.col("c_custkey") * 257).alias("value"))


@query("SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS value, s_acctbal BETWEEN 0 AND 5000 AS allowed FROM supplier")
def range_metadata(spark, sf_dir):
    """A declared range, reported and not enforced."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("value"), F.col("s_acctbal").between(0, 5000).alias("allowed"))


@query(f"WITH {TREE} SELECT s_suppkey, coalesce(TRY_CAST(value AS BIGINT), 0) AS number FROM tree WHERE name IN ('Name', 'Balance')")
def integer_variables(spark, sf_dir):
    """Variables as numbers; 0 for those that are none."""
    return tree(spark, sf_dir).filter("name in ('Name', 'Balance')").select("s_suppkey", number_or_zero(F.col("value")).alias("number"))


@query("SELECT host, slot, dpm, slot * 8 + dpm AS rce FROM (SELECT n_name AS host, slot, dpm FROM nation, (SELECT unnest(range(4)) AS slot), (SELECT unnest([0, 2]) AS dpm))")
def host_map(spark, sf_dir):
    """Every host's slots and processing elements: a fixed few for each."""
    places = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("slot"), F.lit(d).alias("dpm")) for s in range(4) for d in (0, 2)])).alias("p")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("host"), places).select("host", "p.slot", "p.dpm")
    return rows.withColumn("rce", F.col("slot") * 8 + F.col("dpm"))


@query("""SELECT s_suppkey, '<supplier><Balance>' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) || '</Balance><Key>' || s_suppkey || '</Key><Name>' || s_name || '</Name></supplier>' AS xml FROM supplier""")
def xml_write(spark, sf_dir):
    return to_xml(tree(spark, sf_dir), key="s_suppkey", root="supplier")


@query("""SELECT s_suppkey, 'supplier:' || name AS path, CASE name WHEN 'Name' THEN s_name WHEN 'Key' THEN CAST(s_suppkey AS VARCHAR) ELSE CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) END AS value
    FROM supplier, (VALUES ('Name'), ('Key'), ('Balance')) t(name)""")
def xml_flatten(spark, sf_dir):
    """Documents written, parsed and flattened again."""
    return flatten_xml(to_xml(tree(spark, sf_dir), key="s_suppkey", root="supplier"), id_col="s_suppkey")


@query("SELECT r_name || ':' || n_name || '(' || n_nationkey || '):Key' AS path, n_name AS name, CAST(n_nationkey AS INTEGER) AS idx FROM nation JOIN region ON n_regionkey = r_regionkey")
def path_build(spark, sf_dir):
    """Paths built from names and indices, and taken apart again."""
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    made = rows.select(path_of([(F.col("r_name"), None), (F.col("n_name"), F.col("n_nationkey")), (F.lit("Key"), F.lit(None).cast("int"))]).alias("path"))
    part = path_parts(F.col("path"))[1]
    return made.select("path", part["name"].alias("name"), part["idx"].alias("idx"))


_CONVERSIONS = {"Balance": V.Conversion(lambda v: F.format_string("%.2f C", v.cast("double") / 4 - 40), lambda v: F.round((F.regexp_replace(v, " C$", "").cast("double") + 40) * 4).cast("long").cast("string"))}


@query("""SELECT s_suppkey, 'Balance' AS name, printf('%.2f C', CAST(floor(s_acctbal) AS DOUBLE) / 4 - 40) AS shown, CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS written FROM supplier
    UNION ALL SELECT s_suppkey, 'Name', s_name, s_name FROM supplier""")
def conversions_both_ways(spark, sf_dir):
    """Values as they are shown, through a conversion of the user's, and written back through its other direction."""
    rows = tree(spark, sf_dir).filter("name IN ('Balance', 'Name')").select("s_suppkey", "name", "value")
    seen = V.shown(rows, _CONVERSIONS).withColumn("shown", F.col("value"))
    return V.to_write(seen, _CONVERSIONS).withColumnRenamed("value", "written")


@query(f"WITH {TREE} SELECT path || '/' || s_suppkey AS path, s_suppkey, kind, CASE WHEN kind = 'config' AND s_suppkey % 3 = 0 THEN 'default ' || (s_suppkey % 5) ELSE value END AS value FROM tree")
def set_defaults(spark, sf_dir):
    """Configuration variables set to their defaults; status variables, and those that have none, stay."""
    rows = tree(spark, sf_dir).select(F.concat("path", F.lit("/"), "s_suppkey").alias("path"), "s_suppkey", "kind", "value")
    defaults = rows.filter("s_suppkey % 3 = 0").select("path", F.concat(F.lit("default "), F.col("s_suppkey") % 5).alias("value"))
    return V.set_defaults(rows, defaults)


@query("""WITH e AS (SELECT user_id AS key, event_id, ts, event_type, length(props) AS size, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS resets,
        last_value(CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'Enable' ELSE 'Stopped' END END IGNORE NULLS) OVER w AS said FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT key, event_id, coalesce(said, 'Stopped') AS state, CAST(sum(CASE WHEN event_type = 'signup' THEN 0 ELSE size END) OVER (PARTITION BY key, resets ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS count FROM e""")
def run_commands(spark, sf_dir):
    """Commands among the data they work on: the run state as last set, and bytes since the last reset."""
    kind = F.col("event_type")
    command = F.when(kind == "signup", "ResetCount").when(kind == "purchase", "SetRunState")
    state = F.when(F.col("event_id") % 2 == 0, "Enable").otherwise("Stopped")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts", command.alias("command"), state.alias("argument"), F.length("props").alias("size"))
    day, order = F.col("ts").cast("date"), ("ts", "event_id")
    out = V.since_reset(V.run_states(rows, order=order, by=day), order=order, by=day, size=F.col("size"))
    return out.select("key", "event_id", "state", "count")
