"""Filtering a log by the labels of a query tree: what is included, less what is excluded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import Log
from ..model import Tree, event, obj
from ..plans.engine import EvalResult, evaluate

INCLUDED, EXCLUDED = "INCLUDED", "EXCLUDED"


def filter_log(log: Log, tree: Tree | dict | str, result: EvalResult | None = None) -> Log:
    """The part of a log that a tree's labels ask for, over all bindings, satisfied or not. If no variable is included
    anywhere, all of the log is, with its relations; else only what is labelled, so relations need labels of their own.
    A node's bindings are kept in the session's cache (in memory, then on disk), as every label reads them."""
    result = result or evaluate(tree, log)
    tree = result.tree
    marked: dict[tuple[str, str], list[DataFrame]] = {}
    #: Types that variables may have, by variable and by what is included: others' rows need not meet the bindings.
    of_variable: dict[tuple[str, str], set[str]] = {}
    for node in tree.nodes:
        for own, variable in ((node.box.new_events, event), (node.box.new_objects, obj)):
            for k, types in own.items():
                of_variable.setdefault((variable(k).kind, variable(k).name), set()).update(types)
    included: dict[str, set[str] | None] = {}
    inside_of: dict[str, bool] = {}  # whether all pairs to include are of ends that their own labels include
    for i, node in enumerate(tree.nodes):
        full = result.evaluation.results[i].full
        if sum(x in (INCLUDED, EXCLUDED) for x in [*node.box.event_labels.values(), *node.box.object_labels.values(), *[f.get("filterLabel") for f in node.box.filters]]) > 1:
            full = full.persist()
        labelled = [(event(k), x) for k, x in node.box.event_labels.items()] + [(obj(k), x) for k, x in node.box.object_labels.items()]
        for v, label in labelled:
            if label in (INCLUDED, EXCLUDED) and v.name in full.columns:
                marked.setdefault((v.kind, label), []).append(full.select(F.col(v.name).alias("id")))
                if label == INCLUDED:
                    types, known = of_variable.get((v.kind, v.name)), included.get(v.kind, set())
                    included[v.kind] = None if types is None or known is None else known | types
        for f in node.box.filters:
            label = f.get("filterLabel")
            if f["type"] in ("O2E", "O2O") and label in (INCLUDED, EXCLUDED):
                a, b = (event(f["event"]), obj(f["object"])) if f["type"] == "O2E" else (obj(f["object"]), obj(f["other_object"]))
                ends = {v.name for v, x in labelled if x == INCLUDED}
                inside_of[f["type"]] = inside_of.get(f["type"], True) and (label != INCLUDED or {a.name, b.name} <= ends)
                marked.setdefault((f["type"], label), []).append(full.select(F.col(a.name).alias("a"), F.col(b.name).alias("b"), F.lit(f.get("qualifier")).cast("string").alias("q")))
    sets = {k: reduce(DataFrame.union, v) if k[0] in ("O2E", "O2O") else reduce(DataFrame.union, v).distinct() for k, v in marked.items()}
    everything = not any(label == INCLUDED and kind in ("Event", "Object") for kind, label in sets)

    def elements(df: DataFrame, key: str, kind: str) -> DataFrame:
        inside = sets.get((kind, INCLUDED))
        if not everything:
            # Ids are distinct; Spark would push a semi join into every part of a union, with the ids shuffled for each.
            df = df.join(inside, df[key] == inside["id"]).select(*[df[c] for c in df.columns]) if inside is not None else df.where(F.lit(False))
        outside = sets.get((kind, EXCLUDED))
        return df.join(outside, df[key] == outside["id"], "left_anti") if outside is not None else df

    def typed(df: DataFrame, column: str, kind: str) -> DataFrame:
        types = included.get(kind)
        return df if everything or types is None else df.where(F.col(column).isin(sorted(types)))

    events, objects = elements(typed(log.events, "ev_type", "Event"), "ev_id", "Event"), elements(typed(log.objects, "ob_type", "Object"), "ob_id", "Object")

    def relations(df: DataFrame, first: str, keys: tuple[str, str], kind: str) -> DataFrame:
        """Both ends of a log's relations are in the log, so what the labels say of ends decides."""
        a, b = keys
        df = typed(typed(df, "ev_type" if kind == "O2E" else "src_type", first), "ob_type" if kind == "O2E" else "tgt_type", "Object")
        excluded = (first, EXCLUDED) in sets or ("Object", EXCLUDED) in sets
        if everything or excluded or not inside_of.get(kind, True):
            df = elements(elements(df, a, first), b, "Object")

        def meets(marks: DataFrame, how: str, rows: DataFrame) -> DataFrame:
            return rows.join(marks, (rows[a] == marks["a"]) & (rows[b] == marks["b"]) & (marks["q"].isNull() | (marks["q"] == rows["qualifier"])), how)

        if not everything and len(marked.get((kind, INCLUDED), ())) == 1:  # one qualifier, so pairs can be distinct
            df = meets(sets[(kind, INCLUDED)].distinct(), "inner", df).select(*[df[c] for c in df.columns])
        elif not everything:
            df = meets(sets[(kind, INCLUDED)], "left_semi", df) if (kind, INCLUDED) in sets else df.where(F.lit(False))
        return meets(sets[(kind, EXCLUDED)], "left_anti", df) if (kind, EXCLUDED) in sets else df

    e2o = relations(log.e2o, "Event", ("ev_id", "ob_id"), "O2E")
    o2o = relations(log.o2o, "Object", ("src_id", "tgt_id"), "O2O")
    used = events.select(F.lit("event").alias("kind"), F.col("ev_type").alias("type_name")).union(objects.select(F.lit("object"), "ob_type")).distinct()
    return Log(events, objects, elements(typed(log.event_attrs, "ev_type", "Event"), "ev_id", "Event"), elements(typed(log.object_attrs, "ob_type", "Object"), "ob_id", "Object"), e2o.select(*log.e2o.columns), o2o.select(*log.o2o.columns), log.types.join(used, ["kind", "type_name"], "left_semi").select(*log.types.columns), log.single_pairs, log.single_event_attrs)
