"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables (mostly through the funnel view built
from lineitem, orders, customer, nation and part) over their whole extent.
Doubles that are compared by value are rounded to 6 places, as in the
matching SQL in :mod:`segrules.plans.oracle`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segrules.functions import paths
from segrules.operators import features as feat
from segrules.operators.importance import (
    FittedForest,
    ensemble_importance,
    ensemble_nodes,
    fit_forest,
    random_forest_importance,
    recount_nodes,
    select_top_features,
)
from segrules.operators.reduce import reduce_topn, reduce_topn_multi, value_counts_window, value_rank
from segrules.operators.report import frequency, frequency_pct, leaf_coverage, rule_report
from segrules.operators.rules import leaf_conditions, leaf_rules, rule_predicate, rule_text
from segrules.operators.scorer import load_tree, save_tree, score_frame
from segrules.operators.split_search import split_search
from segrules.operators.tree import SegmentTree, fit_segment_tree, leaf_stats, score_rows
from segrules.plans import pipelines
from segrules.session import cut_lineage, shared_path
from segrules.sources.tables import (
    funnel_fixture,
    project_columns,
    read_csv,
    read_table,
    replace_table,
    save_table,
    scan_table,
    sql_rows,
    write_csv,
)

Query = Callable[[SparkSession, str], DataFrame]

# The tree every rule query is built on (FIXTURES.md section 4).
TREE_FEATURES = ["quantity", "discount", "priority", "p_type", "segment"]
CATEGORICAL = ["p_type", "priority", "segment"]
RESPONSE = "converted"
TREE_DEPTH = 5
TAGS = ["l_orderkey", "l_linenumber"]


def r6(c: F.Column | str) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel view.  Queries that read it twice (count, then label) cut
    lineage on their narrow projection first, so the five-way join runs once."""
    return funnel_fixture(spark, sf_dir)


def _fixture_cut(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The funnel view's columns a multi-pass query needs, written once to the shared folder."""
    return cut_lineage(_fixture(spark, sf_dir).select(*columns))


def _tree(spark: SparkSession, sf_dir: str, depth: int = TREE_DEPTH) -> SegmentTree:
    fx = _fixture_cut(spark, sf_dir, *TAGS, *TREE_FEATURES, RESPONSE)
    return fit_segment_tree(fx, RESPONSE, features=TREE_FEATURES, max_depth=depth, max_bins=64, seed=42, keep=TAGS)


# -- sources, projections, filters ----------------------------------------


def q_scan_filter_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join, inequality and contains filters, null-on-bad cast, null drop."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    out = joined.where((F.col("o_custkey") != 0) & F.col("c_mktsegment").like("%MACHIN%")).select(
        "o_orderkey",
        "o_totalprice",
        paths.to_double(F.substring_index("o_orderpriority", "-", 1)).alias("priority_level"),
    )
    return out.na.drop("any")


def q_project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted run-time column list."""
    li = read_table(spark, sf_dir, "lineitem")
    return project_columns(li, ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]).na.drop("any")


def q_csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV written with a header and read back with an explicit schema."""
    part = read_table(spark, sf_dir, "part")
    path = shared_path(spark, "part-csv")
    write_csv(part, path)
    return read_csv(spark, path, schema=part.schema)


def q_replace_table_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwrite (drop and save) twice, read back."""
    nation = read_table(spark, sf_dir, "nation")
    path = shared_path(spark, "nation-table")
    replace_table(nation.where("n_regionkey = 0"), path)
    return replace_table(nation, path)


def q_catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An SQL text over a saved catalog table with bound parameters, a run-time column list, null drop."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    table = f"segrules_orders_{uuid.uuid4().hex}"
    save_table(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), table, ["c_mktsegment"], shared_path(spark, "orders-table"))
    priced = sql_rows(
        spark,
        """SELECT o_orderkey, o_custkey, cast(o_totalprice AS double) AS price, o_orderpriority, c_mktsegment
           FROM IDENTIFIER(:orders) WHERE c_mktsegment LIKE :segment AND o_custkey <> :nobody AND o_totalprice > :least""",
        orders=table, segment="%MACHIN%", nobody=0, least=1000.0,
    )
    named = scan_table(spark, table, ["o_orderkey", "o_orderpriority"], "c_mktsegment = :segment", segment="BUILDING")
    return (
        project_columns(priced, ["o_orderkey", "o_orderpriority"])
        .withColumn("part", F.lit("text"))
        .unionByName(named.withColumn("part", F.lit("name")))
        .na.drop("any")
    )


def q_drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null or NaN anywhere are dropped."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value", "props"])
    with_nulls = ev.select(
        "event_id",
        "user_id",
        F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"),
        F.when(F.col("value") > 50, F.lit(None)).otherwise(F.col("value")).alias("value"),
        "props",
    )
    return with_nulls.na.drop("any")


def q_rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of IN-list and threshold conditions as one predicate."""
    fx = _fixture(spark, sf_dir)
    conds = [
        {"column": "p_type", "nominal": True, "values": ["PROMO", "SMALL"], "op": "<=", "threshold": None},
        {"column": "quantity", "nominal": False, "values": [], "op": ">", "threshold": 30.5},
        {"column": "discount", "nominal": False, "values": [], "op": "<=", "threshold": 0.055},
    ]
    return fx.where(rule_predicate(conds)).select(*TAGS, "p_type", "quantity", "discount")


# -- path cleaning -----------------------------------------------------------


def q_first_path_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first non-empty ``->`` step."""
    fx = _fixture(spark, sf_dir)
    return fx.select(*TAGS, "path", paths.first_path_step("path").alias("first_step"))


def q_normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """separator normalising on the first step."""
    fx = _fixture(spark, sf_dir)
    return fx.select(*TAGS, "path", paths.normalize_separators(paths.first_path_step("path")).alias("normalized"))


def q_last_pipe_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trailing ``|`` pair."""
    fx = _fixture(spark, sf_dir)
    return fx.select(*TAGS, "first_page", paths.last_pipe_pair("first_page").alias("pair"))


def q_page_name_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """landing-page variant of F3."""
    fx = _fixture(spark, sf_dir)
    return fx.select(*TAGS, "first_page", paths.page_name_tail("first_page").alias("tail"))


def q_clean_path_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F5 chained, U1 without a UDF, on real-looking URLs."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    return pages.select("page_id", "url", paths.clean_path("url").alias("cleaned"))


# -- value counts, ranks, reductions ------------------------------------------


def q_value_counts_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with its value's count."""
    fx = cut_lineage(_fixture(spark, sf_dir).select(*TAGS, "first_page"))
    return value_counts_window(fx, "first_page", keep=TAGS)


def q_value_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values ranked by count desc, value desc, without a single-task window."""
    return value_rank(_fixture(spark, sf_dir), "first_page")


def q_reduce_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column collapsed to its top 15."""
    fx = cut_lineage(_fixture(spark, sf_dir).select(*TAGS, "first_page"))
    return reduce_topn(fx, "first_page", 15)


def q_reduce_topn_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: two columns collapsed (15 and 25) from one counting pass."""
    fx = cut_lineage(_fixture(spark, sf_dir).select(*TAGS, "first_page", paths.clean_path("path").alias("path")))
    return reduce_topn_multi(fx, [("first_page", 15), ("path", 25)])


# -- features -----------------------------------------------------------------


def q_category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency-descending index, ties alphabetical."""
    return feat.category_index(_fixture(spark, sf_dir), CATEGORICAL)


def q_category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: distinct (feature, value, idx) read back from the indexed frame."""
    fm = feat.feature_matrix(_fixture_cut(spark, sf_dir, *TREE_FEATURES, RESPONSE), RESPONSE, features=TREE_FEATURES)
    return feat.category_lookup(fm.data, CATEGORICAL)


def q_category_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every index cut of each category as a quoted value list."""
    lookup = feat.category_index(_fixture(spark, sf_dir), CATEGORICAL)
    return feat.category_conditions(lookup)


def q_interval_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories between the cuts that the tree uses, each value in one list."""
    tree = _tree(spark, sf_dir)
    splits = tree.nodes.where("not is_leaf").select("feature_name", "threshold").distinct()
    cuts = splits.where(F.col("feature_name").isin(list(tree.fm.nominal))).select(
        F.regexp_replace("feature_name", f"{feat.INDEX_SUFFIX}$", "").alias("feature"), "threshold"
    )
    lists = feat.interval_values(tree.fm.index, cuts)
    return lists.select("feature", F.col("interval").cast("long").alias("interval"), F.array_join("values", ",").alias("value_list"))


def _matrix_columns(fm: feat.FeatureMatrix) -> list[F.Column]:
    arr = F.col("__arr")
    return [arr[i].alias(s) for i, s in enumerate(fm.slots)] + [F.col(fm.label_col).alias("label")]


def q_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: numerics first, then indexed categories; response index as label."""
    fx = _fixture_cut(spark, sf_dir, *TAGS, *TREE_FEATURES, RESPONSE)
    fm = feat.feature_matrix(fx, RESPONSE, features=TREE_FEATURES)
    tagged = fm.transform(fx).withColumn("__arr", feat.vector_to_array(F.col("features")))
    return tagged.select(*TAGS, *_matrix_columns(fm))


def q_feature_matrix_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: every feature cast to string and indexed."""
    fx = _fixture_cut(spark, sf_dir, *TAGS, *TREE_FEATURES, RESPONSE)
    fm = feat.feature_matrix(fx, RESPONSE, features=TREE_FEATURES, all_categorical=True)
    strings = fx.select(*TAGS, *[F.col(c).cast("string").alias(c) for c in [*TREE_FEATURES, RESPONSE]])
    tagged = fm.transform(strings).withColumn("__arr", feat.vector_to_array(F.col("features")))
    return tagged.select(*TAGS, *_matrix_columns(fm))


def q_categorical_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: slots with at most 10 distinct values marked categorical."""
    fm = feat.feature_matrix(_fixture_cut(spark, sf_dir, *TREE_FEATURES, RESPONSE), RESPONSE, features=TREE_FEATURES)
    return feat.categorical_slots(fm, max_categories=10)


def q_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest importances named by slot (rows-only check)."""
    fx = _fixture_cut(spark, sf_dir, *TREE_FEATURES, "nation", "p_brand", RESPONSE)
    return random_forest_importance(fx, RESPONSE, seed=7)


def _exact_forest(spark: SparkSession, sf_dir: str) -> FittedForest:
    columns = [*TREE_FEATURES, "nation", "p_brand"]
    fx = _fixture_cut(spark, sf_dir, *columns, RESPONSE)
    return fit_forest(fx, RESPONSE, features=columns, **asdict(pipelines.EXACT_FOREST))


def q_importance_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances from the node table of a forest without randomness (one tree, all rows and features)."""
    fitted = _exact_forest(spark, sf_dir)
    found = ensemble_importance(ensemble_nodes(fitted), fitted.fm)
    return found.select("feature_name", r6("importance").alias("importance"), "splits")


def q_ensemble_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest's node table by heap id, with each node's rows counted anew by routing them."""
    fitted = _exact_forest(spark, sf_dir)
    nodes = ensemble_nodes(fitted)
    counted = recount_nodes(nodes, fitted.fm.data)
    return nodes.join(counted, "node").select(
        F.col("node").cast("int").alias("node"), "is_leaf", "prediction", r6("impurity").alias("impurity"), r6("gain").alias("gain"),
        "feature_name", "threshold", F.col("count").cast("long").alias("count"), "rows",
    )


def _split_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    fx = _fixture_cut(spark, sf_dir, "l_orderkey", *TREE_FEATURES, RESPONSE)
    fm = feat.feature_matrix(fx, RESPONSE, features=TREE_FEATURES, keep=["l_orderkey"])
    return fm.data, fm.slots


def q_split_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: best gini cut per feature, one of them with a value per order."""
    data, slots = _split_input(spark, sf_dir)
    best = split_search(data, RESPONSE, [*slots, "l_orderkey"])
    return best.select("feature", "threshold", r6("gain").alias("gain"), "left_count", "right_count")


def q_select_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 3 by gain, then the response."""
    data, slots = _split_input(spark, sf_dir)
    gains = split_search(data, RESPONSE, slots).select(
        F.col("feature").alias("feature_name"), r6("gain").alias("importance")
    )
    return select_top_features(gains, 3, response=RESPONSE)


# -- tree, rules, report --------------------------------------------------------


def q_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heap-numbered node table."""
    nodes = _tree(spark, sf_dir).nodes
    return nodes.select(
        "node", "is_leaf", "prediction", r6("probability").alias("probability"), r6("impurity").alias("impurity"),
        "feature_name", "threshold",
    )


def _path_text(conds: DataFrame) -> DataFrame:
    part = F.concat_ws(" ", "feature", "op", F.col("threshold").cast("string"))
    return conds.groupBy("node").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", part.alias("t")))), lambda s: s["t"]), " ; ").alias("path")
    )


def q_leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full root-to-leaf conditions."""
    nodes = _tree(spark, sf_dir).nodes
    return _path_text(leaf_conditions(nodes, "full", "all"))


def q_leaf_paths_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent and leaf scopes, deepest condition per feature."""
    nodes = _tree(spark, sf_dir).nodes
    parent = _path_text(leaf_conditions(nodes, "parent", "last")).withColumn("scope", F.lit("parent"))
    leaf = _path_text(leaf_conditions(nodes, "leaf", "last")).withColumn("scope", F.lit("leaf"))
    return parent.unionByName(leaf).select("scope", "node", "path")


def q_rule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Print, sql, html and where forms of each rule."""
    rules = cut_lineage(leaf_rules(_tree(spark, sf_dir)))  # one row per leaf, read by four styles
    styles = [
        rules.select("node", F.lit("print").alias("style"), rule_text("rule_list", "print").alias("rules")),
        rules.select("node", F.lit("sql").alias("style"), rule_text("rule_list", "sql").alias("rules")),
        rules.select(
            "node", F.lit("html").alias("style"), rule_text("rule_list", "html", {"p_type": "product_type"}).alias("rules")
        ),
        rules.select("node", F.lit("where").alias("style"), rule_text("rule_list", "where").alias("rules")),
    ]
    return styles[0].unionByName(styles[1]).unionByName(styles[2]).unionByName(styles[3])


def q_rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of full and parent-scope rules from routed rows."""
    tree = _tree(spark, sf_dir)
    conditioned = tree.leaves.where("depth > 1").select("node")  # the parent scope has no rule for a child of the root
    full = leaf_coverage(tree, scope="full").withColumn("scope", F.lit("full"))
    parent = leaf_coverage(tree, scope="parent").join(conditioned, "node").withColumn("scope", F.lit("parent"))
    return full.unionByName(parent).select(
        "scope",
        "node",
        "coverage",
        r6(frequency(F.col("coverage"), F.col("total"))).alias("frequency"),
        frequency_pct(F.col("coverage"), F.col("total")).alias("frequency_pct"),
    )


def q_leaf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf statistics recounted from the data."""
    st = leaf_stats(_tree(spark, sf_dir))
    return st.select("node", "prediction", r6("probability").alias("probability"), r6("impurity").alias("impurity"), "coverage")


def q_node_rule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules joined with leaf statistics."""
    tree = _tree(spark, sf_dir)
    rules = leaf_rules(tree).select("node", rule_text("rule_list").alias("rules"))
    stats = tree.leaves.select("node", "prediction", r6("probability").alias("probability"))
    return rules.join(F.broadcast(stats), "node", "inner").select("node", "prediction", "probability", "rules")


def q_score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's prediction and probability."""
    scored = score_rows(_tree(spark, sf_dir), keep=TAGS)
    return scored.select(*TAGS, "prediction", r6("probability").alias("probability"))


def q_score_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved tree, loaded again, scores another frame, which holds a category the tree has not seen."""
    path = shared_path(spark, "saved-tree")
    save_tree(_tree(spark, sf_dir), path)
    fx = _fixture(spark, sf_dir)
    other = fx.withColumn("priority", F.when(F.col("l_linenumber") == 7, F.lit("0-NEW")).otherwise(F.col("priority")))
    scored = score_frame(load_tree(spark, path), other.select(*TAGS, *TREE_FEATURES), unseen="keep")
    return scored.select(*TAGS, "node", "prediction", "predicted_label", r6("probability").alias("probability"))


def _report_rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "node", "prediction", r6("probability").alias("probability"), "rules", "coverage",
        r6("frequency").alias("frequency"), "frequency_pct", *more,
    )


def q_rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf report (flagship; also entry())."""
    return _report_rounded(rule_report(_tree(spark, sf_dir)))


def q_rules_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-leaf tree and minimum-leaf guard give empty reports."""
    fx = _fixture_cut(spark, sf_dir, *TREE_FEATURES, RESPONSE)
    constant = fx.where(F.col(RESPONSE) == 1)
    single = fit_segment_tree(constant, RESPONSE, features=TREE_FEATURES, max_depth=TREE_DEPTH)
    stump = fit_segment_tree(fx, RESPONSE, features=TREE_FEATURES, max_depth=1)
    cases = [
        ("single_leaf", rule_report(single)),
        ("depth1_min4", rule_report(stump, min_leaves=4)),
        ("depth1_min2", rule_report(stump, min_leaves=2)),
    ]
    counts = [df.agg(F.count(F.lit(1)).alias("report_rows")).select(F.lit(name).alias("scenario"), "report_rows") for name, df in cases]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def q_segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline."""
    # As in the reference: the landing page is trimmed to its last ``|`` pair
    # and the response cast to double (both inside the pipeline).
    fx = (
        _fixture(spark, sf_dir)
        .withColumnRenamed("first_page", "first_hit_pagename")
        .withColumnRenamed("path", "post_prop11_concat")
    )
    return _report_rounded(
        pipelines.segment_report(
            fx,
            RESPONSE,
            forest=pipelines.ForestParams(seed=7),
            exclude=TAGS,
            page_column="first_hit_pagename",
        )
    )


def q_segment_report_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline where selection matters: the 3 most important of 9 features, ranked without
    randomness, make the tree; with the predicted label."""
    fx = (
        _fixture(spark, sf_dir)
        .withColumnRenamed("first_page", "first_hit_pagename")
        .withColumnRenamed("path", "post_prop11_concat")
    )
    report = pipelines.segment_report(
        fx, RESPONSE, num_features=3, forest=pipelines.EXACT_FOREST, exclude=TAGS, page_column="first_hit_pagename", with_label=True
    )
    return _report_rounded(report, "predicted_label")


def q_rule_report_all_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance job, then all-categorical parent-scope rules."""
    # N covers all six candidates, so the forest's ranking cannot change the tree.
    fx = _fixture_cut(spark, sf_dir, *TREE_FEATURES, "nation", RESPONSE)
    importance = pipelines.importance_job(
        fx, [*TREE_FEATURES, "nation"], RESPONSE, replace(pipelines.IMPORTANCE_FOREST, seed=7)
    )
    return _report_rounded(pipelines.rules_job(fx, importance, 6, RESPONSE))


def q_train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.6/0.4 split with seed 11."""
    fx = _fixture_cut(spark, sf_dir, *TAGS, RESPONSE)
    train, test = pipelines.train_test_split(fx, (0.6, 0.4), 11)
    return train.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("train").alias("part"), "rows").unionByName(
        test.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("test").alias("part"), "rows")
    )


QUERIES: dict[str, Query] = {
    "scan_filter_cast": q_scan_filter_cast,
    "project_columns": q_project_columns,
    "csv_source": q_csv_source,
    "replace_table_sink": q_replace_table_sink,
    "catalog_scan": q_catalog_scan,
    "drop_nulls": q_drop_nulls,
    "rule_filter": q_rule_filter,
    "first_path_step": q_first_path_step,
    "normalize_path": q_normalize_path,
    "last_pipe_pair": q_last_pipe_pair,
    "page_name_tail": q_page_name_tail,
    "clean_path_column": q_clean_path_column,
    "value_counts_window": q_value_counts_window,
    "value_rank": q_value_rank,
    "reduce_topn": q_reduce_topn,
    "reduce_topn_multi": q_reduce_topn_multi,
    "category_index": q_category_index,
    "category_lookup": q_category_lookup,
    "category_condition": q_category_condition,
    "interval_values": q_interval_values,
    "feature_matrix": q_feature_matrix,
    "feature_matrix_categorical": q_feature_matrix_categorical,
    "categorical_slots": q_categorical_slots,
    "feature_importance": q_feature_importance,
    "importance_exact": q_importance_exact,
    "ensemble_nodes": q_ensemble_nodes,
    "select_top_features": q_select_top_features,
    "split_search": q_split_search,
    "tree_nodes": q_tree_nodes,
    "leaf_paths": q_leaf_paths,
    "leaf_paths_parent": q_leaf_paths_parent,
    "rule_text": q_rule_text,
    "rule_coverage": q_rule_coverage,
    "leaf_stats": q_leaf_stats,
    "node_rule_join": q_node_rule_join,
    "score_rows": q_score_rows,
    "score_saved": q_score_saved,
    "rule_report": q_rule_report,
    "rules_degenerate": q_rules_degenerate,
    "segment_report": q_segment_report,
    "segment_report_selected": q_segment_report_selected,
    "rule_report_all_categorical": q_rule_report_all_categorical,
    "train_test_split": q_train_test_split,
}
