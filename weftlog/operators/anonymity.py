"""k-anonymity, l-diversity and t-closeness of a box's bindings against policies of quasi-identifiers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..log import Log, rendered
from ..model import EVENT, Box, Variable
from ..plans.engine import Frame, columns_of, evaluate, vars_of

_PREDICATES = ("O2E", "O2O", "TimeBetweenEvents")


@dataclass(frozen=True)
class QuasiIdentifier:
    """A pattern box, the variable that is protected, and where a value is read: a variable and Id, Timestamp or a name."""

    pattern: Box
    protected: Variable
    source: Variable
    attribute: str

    def validate(self) -> None:
        bad = [f["type"] for f in self.pattern.filters if f["type"] not in _PREDICATES]
        if bad:
            raise ValueError(f"a pattern has relations and time windows only, not {bad}")
        for v in (self.protected, self.source):
            if v not in self.pattern.new_vars:
                raise ValueError(f"{v.name} is no variable of the pattern")
        if self.attribute == "Timestamp" and self.source.kind != EVENT:
            raise ValueError("only events have a timestamp")

    __hash__ = object.__hash__


@dataclass
class Policy:
    qids: list[QuasiIdentifier]
    sensitive: list[str]
    k: int = 2
    l: int = 1  # noqa: E741
    t: float = 1.0

    def validate(self) -> None:
        if not self.qids:
            raise ValueError("a policy has at least one quasi-identifier")
        for q in self.qids:
            q.validate()
        kinds = {tuple(sorted(q.pattern.new_vars[q.protected])) for q in self.qids}
        if len(kinds) > 1:
            raise ValueError("all quasi-identifiers protect the same types")
        if self.k < 1 or not 0 <= self.t <= 1:
            raise ValueError("k is at least 1, t between 0 and 1")


def compatible(p: dict, f: dict, to: dict[Variable, Variable]) -> bool:
    """Whether a box's predicate can stand for a pattern's under a renaming."""
    if p["type"] != f["type"]:
        return False
    order = lambda x: [Variable("Event" if "event" in k else "Object", x[k]) for k in {"O2E": ("object", "event"), "O2O": ("object", "other_object"), "TimeBetweenEvents": ("from_event", "to_event")}[x["type"]]]
    if [to[v] for v in order(p)] != order(f):
        return False
    if p["type"] != "TimeBetweenEvents":
        return p.get("qualifier") is None or f.get("qualifier") is None or p["qualifier"] == f["qualifier"]
    low = max(x.get("min_seconds") if x.get("min_seconds") is not None else float("-inf") for x in (p, f))
    high = min(x.get("max_seconds") if x.get("max_seconds") is not None else float("inf") for x in (p, f))
    return low <= high


def matchings(pattern: Box, box: Box) -> list[dict[Variable, Variable]]:
    """All injective maps of the pattern's variables to the box's, with common types and a compatible predicate for each
    of the pattern's. Patterns have a handful of variables, so this is a search on the driver."""
    variables, out = sorted(pattern.new_vars), []

    def extend(k: int, to: dict[Variable, Variable]) -> None:
        if k == len(variables):
            out.append(dict(to))
            return
        v = variables[k]
        for w in sorted(box.new_vars):
            if w.kind != v.kind or w in to.values() or not set(pattern.new_vars[v]) & set(box.new_vars[w]):
                continue
            to[v] = w
            ready = [p for p in pattern.filters if v in vars_of(p) and vars_of(p) <= set(to)]
            if all(any(compatible(p, f, to) for f in box.filters) for p in ready):
                extend(k + 1, to)
            del to[v]

    extend(0, {})
    return out


def renamed(p: dict, to: dict[Variable, Variable]) -> dict:
    keys = {"object": "Object", "other_object": "Object", "event": "Event", "from_event": "Event", "to_event": "Event"}
    return {k: to[Variable(keys[k], v)].index if k in keys else v for k, v in p.items()}


class Check:
    """One policy against one box: everything but the matchings is DataFrames."""

    def __init__(self, policy: Policy, box: Box, log: Log):
        policy.validate()
        if box.constraints or box.labels:
            raise ValueError("a box that is checked has no constraints and no labels")
        self.policy, self.box, self.log = policy, box, log
        self.found = [matchings(q.pattern, box) for q in policy.qids]
        result = evaluate({"nodes": [{"Box": [box.to_json(), []]}], "edgeNames": []}, log)
        self.bindings, self.types = result.evaluation.results[0].full, dict(box.new_vars)
        parts = []
        for q, ms in zip(policy.qids, self.found, strict=True):
            wanted = set(q.pattern.new_vars[q.protected])
            for w in {m[q.protected] for m in ms} or {v for v, ts in box.new_vars.items() if v.kind == q.protected.kind and set(ts) & wanted}:
                parts.append(self.bindings.where(F.col(f"_y_{w.name}").isin(sorted(wanted))).select(F.col(w.name).alias("id"), F.lit(w.kind).alias("kind")))
        self.protected = reduce(DataFrame.union, parts).distinct() if parts else self.bindings.select(F.lit("").alias("id"), F.lit("").alias("kind")).limit(0)

    def _values(self, q: QuasiIdentifier, to: dict[Variable, Variable]) -> DataFrame:
        """id (protected), src, val of the bindings that the pattern's predicates hold for."""
        frame = Frame(self.bindings.select(*[c for v in self.types for c in columns_of(v)]), dict(self.types), self.log)
        for p in q.pattern.filters:
            ok = frame.holds(renamed(p, to))
            frame.df = frame.df.where(ok)
        for v, w in to.items():
            frame.df = frame.df.where(F.col(f"_y_{w.name}").isin(list(q.pattern.new_vars[v])))
        src = to[q.source]
        if q.attribute == "Id":
            val = F.col(src.name)
        elif q.attribute == "Timestamp":
            val = F.date_format(F.col(f"_t_{src.name}"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        else:
            val = rendered(F.col(frame.value(src, q.attribute, "earliest")))
        return frame.df.select(F.col(to[q.protected].name).alias("id"), F.concat(F.col(f"_y_{src.name}"), F.lit(":"), F.col(src.name)).alias("src"), F.coalesce(val, F.lit("\u0000")).alias("val")).distinct()

    def fingerprints(self) -> DataFrame:
        """id, kind, fp: for each quasi-identifier the sorted values with their multiplicities; empty if it is not active."""
        df = self.protected
        for i, (q, ms) in enumerate(zip(self.policy.qids, self.found, strict=True)):
            if not ms:
                df = df.withColumn(f"_f{i}", F.lit(""))
                continue
            sources = reduce(DataFrame.union, [self._values(q, m) for m in ms]).distinct()
            counted = sources.groupBy("id", "val").agg(F.count("*").alias("n"))
            own = counted.groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("val", "n")))).alias(f"_f{i}"))
            df = df.join(own, "id", "left").withColumn(f"_f{i}", F.coalesce(f"_f{i}", F.lit("")))
        parts = [F.col(f"_f{i}") for i in range(len(self.policy.qids))]
        return df.select("id", "kind", F.concat_ws("|", *parts).alias("fp"))

    def members(self) -> DataFrame:
        """id, fp, sensitive: the tuple of sensitive values (an object's or event's first listed; null as such) as JSON."""
        df = self.fingerprints()
        names = []
        for i, name in enumerate(self.policy.sensitive):
            one = self.log.object_values(name).select(F.col("ob_id").alias("id"), rendered(F.col("v")).alias(f"_s{i}"))
            two = self.log.event_values(name).select(F.col("ev_id").alias("id"), rendered(F.col("v")).alias(f"_e{i}"))
            df = df.join(one, "id", "left").join(two, "id", "left").withColumn(f"_s{i}", F.when(F.col("kind") == EVENT, F.col(f"_e{i}")).otherwise(F.col(f"_s{i}"))).drop(f"_e{i}")
            names.append(f"_s{i}")
        packed: Column = F.to_json(F.array(*[F.coalesce(F.col(n), F.lit("\u0000")) for n in names])) if names else F.lit("[]")
        return df.select("id", "fp", packed.alias("sensitive"), *names)

    def classes(self) -> DataFrame:
        """fp, size, distinct_sensitive, emd of each class."""
        m = self.members().select("fp", "sensitive")
        local = m.groupBy("fp", "sensitive").agg(F.count("*").alias("n"))
        sizes = m.groupBy("fp").agg(F.count("*").alias("size"), F.count_distinct("sensitive").alias("distinct_sensitive"))
        total = m.agg(F.count("*").alias("total"))
        world = m.groupBy("sensitive").agg(F.count("*").alias("g")).crossJoin(F.broadcast(total))  # total is one row
        shared = local.join(sizes.select("fp", "size"), "fp").join(world, "sensitive").groupBy("fp").agg(F.sum(F.least(F.col("n") / F.col("size"), F.col("g") / F.col("total"))).alias("shared"))
        emd = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(1 - F.col("shared"), 12)))
        return sizes.join(shared, "fp").select("fp", "size", "distinct_sensitive", emd.alias("emd"))

    def verdict(self) -> DataFrame:
        """activated, protected, classes, k_ok, l_ok, t_ok, k_max, l_max, t_min (least EMD) and t_max_emd (greatest)."""
        p = self.policy
        c = self.classes()
        every = lambda ok: F.coalesce(F.bool_and(ok), F.lit(True))
        return c.agg(
            F.coalesce(F.sum("size"), F.lit(0)).alias("protected"),
            F.count("*").alias("classes"),
            every(F.col("size") >= p.k).alias("k_ok"),
            every(F.lit(p.l == 0) | (F.col("distinct_sensitive") >= p.l)).alias("l_ok"),
            every(F.lit(p.t >= 1) | (F.col("emd") <= p.t)).alias("t_ok"),
            F.coalesce(F.min("size"), F.lit(0)).alias("k_max"),
            F.coalesce(F.min("distinct_sensitive"), F.lit(0)).alias("l_max"),
            F.min("emd").alias("t_min"),
            F.max("emd").alias("t_max_emd"),
        ).select(F.lit(all(bool(m) for m in self.found)).alias("activated"), "*")

    def at_risk(self) -> DataFrame:
        """id of the members of classes below k."""
        low = self.classes().where(F.col("size") < self.policy.k).select("fp")
        return self.members().join(low, "fp", "left_semi").select("id").distinct()

    def sensitive_at_risk(self) -> DataFrame:
        """attribute, value: sensitive values in classes that break l or t."""
        p = self.policy
        bad = (F.lit(p.l > 0) & (F.col("distinct_sensitive") < p.l)) | (F.lit(p.t < 1) & (F.col("emd") > p.t))
        rows = self.members().join(self.classes().where(bad).select("fp"), "fp", "left_semi")
        if not p.sensitive:
            return rows.select(F.lit("").alias("attribute"), F.lit("").alias("value")).limit(0)
        pairs = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(f"_s{i}").alias("value")) for i, n in enumerate(p.sensitive)])
        return rows.select(F.inline(pairs)).where("value is not null").distinct()


@dataclass
class Report:
    """All that a check finds: the verdict's row, classes largest first, and who and what is at risk."""

    verdict: dict
    classes: DataFrame
    at_risk: DataFrame
    sensitive_at_risk: DataFrame

    @property
    def holds(self) -> bool:
        return bool(self.verdict["k_ok"] and self.verdict["l_ok"] and self.verdict["t_ok"])

    def line(self) -> str:
        v = self.verdict
        shown = "none" if v["t_min"] is None else f"{v['t_min']:.3f}"
        state = "holds" if self.holds else "is broken: " + ", ".join(x for x in "klt" if not v[f"{x}_ok"])
        return f"{v['protected']} protected in {v['classes']} classes, k up to {v['k_max']}, l up to {v['l_max']}, t from {shown}; the policy {state}" + ("" if v["activated"] else " (not active)")


def check_policy(policy: Policy, box: Box, log: Log) -> Report:
    """The report of a policy on what a box binds; only the verdict, one row, is computed at once."""
    check = Check(policy, box, log)
    return Report(check.verdict().first().asDict(), check.classes().orderBy(F.desc("size"), "fp"), check.at_risk(), check.sensitive_at_risk())
