"""Orchestration: build a baseline from a run set, and check a run against it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..operators import causal, cluster, correlate, drift, profile, quality
from ..operators.obs import run_sizes, sample_runs, trajectory_band
from ..sources import artifacts, ingest, tables


@dataclass
class Baseline:
    """Artifact tables by name, written and read back."""

    tables: dict[str, DataFrame]
    thresholds: Thresholds = field(default_factory=Thresholds)

    @property
    def variables(self) -> list[str]:
        return correlate.variables_of(self.tables["obs"])


def build_baseline(obs: DataFrame, root: str, rules: DataFrame | None = None, n_runs: int | None = None, seed: int = 0, with_causal: bool = True, t: Thresholds = Thresholds(), labels: DataFrame | None = None, metadata: dict | None = None, progress: Callable[[str, int, int], None] | None = None) -> Baseline:
    """Every artifact of a run set under ``root``. ``n_runs`` draws that many runs first; the draw is a
    list of ids, so it prunes a table that is laid out by run. ``progress`` hears each step's name, its
    number and how many there are; the seconds that each took are in the marker written at the end."""
    spark, root = obs.sparkSession, root.rstrip("/")
    if n_runs:
        ids = [r["run_id"] for r in run_sizes(obs).select("run_id").collect()]
        obs = obs.where(F.col("run_id").isin(sample_runs(ids, n_runs, seed)))
    artifacts.write_table(obs, root, "obs")
    done = lambda name: artifacts.read_artifacts(spark, root)[name]
    obs = done("obs")
    steps: dict[str, Callable[[], DataFrame]] = {
        "runs": lambda: run_sizes(obs),
        "profile": lambda: profile.per_run(obs),
        "alerts": lambda: profile.alerts(done("profile")),
        "pooled_profile": lambda: profile.pooled(obs),
        "pooled_alerts": lambda: profile.alerts(done("pooled_profile")),
        "quality": lambda: quality.verdict(obs, rules, t),
        "baseline": lambda: drift.baseline(obs),  # a check reads this and the correlations
        "corr": lambda: correlate.pearson(obs),
    }
    if labels is not None:
        steps["labels"] = lambda: labels
        steps["label_summary"] = lambda: profile.label_summary(done("labels"), [c for c in labels.columns if c not in ("run_id", "sample")])
    grouped: dict[str, DataFrame] = {}
    for part in ("clusters", "cluster_scores", "linkage"):
        steps[part] = lambda part=part: (grouped or grouped.update(cluster.clustering(done("corr"))) or grouped)[part]
    if with_causal:
        steps |= {
            "links": lambda: causal.links(obs, t),
            "causal_status": lambda: causal.run_status(obs, done("links"), t),
            "link_frequency": lambda: causal.link_frequency(done("links")),
            "lag_profiles": lambda: causal.lag_arrays(done("links")),
        }
    seconds = {}
    for k, (name, make) in enumerate(steps.items()):
        if progress:
            progress(name, k, len(steps))
        began = time.monotonic()
        artifacts.write_table(make(), root, name)
        if name in ("profile", "pooled_profile"):
            artifacts.write_json(done(name), f"{root}/{name}_json")
        seconds[name] = round(time.monotonic() - began, 2)
    artifacts.write_document(spark, f"{root}/dataset_meta.json", {**(metadata or {}), "variables": correlate.variables_of(obs), "n_runs": done("runs").count()})
    artifacts.mark_complete(spark, root, tables=sorted(["obs", *steps]), seconds=seconds)
    return load_baseline(spark, root, t)


def load_baseline(spark: SparkSession, root: str, t: Thresholds = Thresholds()) -> Baseline:
    return Baseline(artifacts.read_artifacts(spark, root), t)


def check_run(base: Baseline, obs: DataFrame, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scores new runs against a baseline: the summary and its supporting tables. Of the baseline only the
    pooled tables are read, a row per variable or pair, never its observations. Variables that the
    baseline lacks are dropped; a missing one is an error."""
    t = base.thresholds
    known = base.variables
    here = {r["variable"] for r in obs.select("variable").distinct().collect()}
    gone = [v for v in known if v not in here]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone[:8])}" + (f" and {len(gone) - 8} more" if len(gone) > 8 else ""))
    places = F.array(*map(F.lit, known))
    obs = obs.where(F.col("variable").isin(known)).withColumn("var_pos", (F.array_position(places, F.col("variable")) - 1).cast("int"))
    found = drift.analyse(obs, drift.Known(base.tables["baseline"], base.tables["corr"]), rules, t, pair_p_values=True)
    shifts = drift.mean_shift(found["sizes"], base.tables["baseline"], len(known), t)
    out = {
        "summary": found["summary"],
        "quality": found["quality"],
        "mean_shift": shifts,
        "top_mean_drifted": drift.top_mean_drifted(shifts),
        "variance_shift": found["spreads"],
        "top_pairs": correlate.top_drifted(found["pairs"]),
        "onsets": found["onsets"],
        "traces": drift.traces(found["obs"], base.tables["baseline"], found["onsets"]),
    }
    out["statistics"] = shifts.join(out["variance_shift"].drop("var_pos", "p_value"), ["run_id", "variable"])
    if "links" in base.tables:  # the causal perspective is the baseline's: a check runs no PCMCI
        links = base.tables["links"]
        status = base.tables["causal_status"]
        agreed = causal.consensus(causal.link_frequency(links), status.where("status = 'ok'").count(), t.consensus)
        out |= {"causal_status": status, "causal_links": agreed, "causal_summary": causal.summary(agreed)}
    return out


def export_check(result: dict[str, DataFrame], root: str, pairs: int = 10, links: int = 30) -> dict[str, DataFrame]:
    """What ``check_run`` found, as tables: the ranked summary, each run's statistics and onsets in parts of
    their own, the ``pairs`` most drifted pairs of each run, and the first ``links`` of those that runs
    agree on and of the others."""
    root = root.rstrip("/")
    spark = result["summary"].sparkSession
    ranking = Window.orderBy(F.desc("anomaly_score"), "run_id")
    steps = {
        "drift": result["summary"].withColumn("place", F.row_number().over(ranking)),
        "quality": result["quality"],
        "statistics": result["statistics"],
        "onsets": result["onsets"],
        "pairs": result["top_pairs"].where(F.col("rank") <= pairs),
    }
    if "causal_links" in result:
        order = [F.desc("n_runs"), F.desc(F.abs("mean_val")), "src", "tgt", "tau"]
        steps |= {
            "consensus": result["causal_links"].where("consensus").orderBy(*order).limit(links),
            "other_links": result["causal_links"].where("not consensus").orderBy(*order).limit(links),
            "causal_summary": result["causal_summary"],
        }
    for name, df in steps.items():
        artifacts.write_table(df, root, name)
    artifacts.mark_complete(spark, root, tables=sorted(steps))
    return artifacts.read_artifacts(spark, root)


def export_inference(spark: SparkSession, root: str, identities: dict | None = None, types: dict | None = None, roles: dict | None = None, root_cause: dict | None = None) -> DataFrame:
    """What a client inferred, beside the artifacts: one document, and the table ``inference`` with a row for
    each kind and name (``kind, name, value``; a value that is not a text is JSON)."""
    root = root.rstrip("/")
    found = {"identity": identities or {}, "type": types or {}, "cluster_role": roles or {}, "root_cause": root_cause or {}}
    artifacts.write_document(spark, f"{root}/inference.json", found)
    rows = [(kind, str(name), value if isinstance(value, str) else json.dumps(artifacts.plain(value), ensure_ascii=False)) for kind, own in found.items() for name, value in own.items()]
    artifacts.write_table(spark.createDataFrame(rows, "kind string, name string, value string"), root, "inference")
    return artifacts.read_artifacts(spark, root)["inference"]


def export_comparison(base: Baseline, root: str, run_a: str, run_b: str) -> DataFrame:
    """Two runs' profiles side by side, written among the baseline's artifacts."""
    artifacts.write_table(profile.compare(base.tables["profile"], run_a, run_b), root, "comparison")
    return artifacts.read_artifacts(base.tables["profile"].sparkSession, root)["comparison"]


def dashboard(base: Baseline, rules: DataFrame | None = None, identities: dict[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """A card per variable: identity and type (as inferred), statistics, cluster, degrees, alerts and active
    rules, by left joins."""
    found, spark = base.tables, base.tables["pooled_profile"].sparkSession
    marks = profile.alerts(found["pooled_profile"]).groupBy("variable").agg(F.sort_array(F.collect_set("alert")).alias("alerts"))
    out = found["pooled_profile"].select("variable", "mean", "std", "min", "max", "n_missing").join(found["clusters"].select("variable", "cluster_id"), "variable", "left").join(marks, "variable", "left")
    if "links" in found:
        out = out.join(causal.degrees(causal.link_frequency(found["links"])).select("variable", "out_degree", "in_degree"), "variable", "left")
    for name, known in (("identity", identities), ("type", types)):
        if known:
            out = out.join(spark.createDataFrame(list(known.items()), f"variable string, {name} string"), "variable", "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("string"))
    if rules is not None:
        out = out.join(rule_cards(rules), "variable", "left")
    return out


def rule_cards(rules: DataFrame) -> DataFrame:
    """``variable, rules``: each variable's active rules in the order of their ids."""
    return quality.active_rules(rules).groupBy("variable").agg(F.sort_array(F.collect_list(F.struct("rule_id", "min", "max", "description"))).alias("rules"))


def figure_data(base: Baseline, checked: dict[str, DataFrame] | None = None, top: int = 10) -> dict[str, DataFrame]:
    """The data behind every figure of a baseline and, with ``checked``, of a check."""
    found = base.tables
    names = base.variables
    out = {
        "trajectories": trajectory_band(found["obs"]),
        "histogram": profile.histogram(found["obs"]),
        "density": profile.kde(found["obs"]),
        "heatmap": correlate.heatmap_variables(found["corr"], len(names)),
        "dendrogram": found["linkage"],
        "clusters": found["clusters"],
    }
    if "links" in found:
        n = found["causal_status"].where("status = 'ok'").count()
        out |= {"link_frequency": causal.top_links(found["link_frequency"]), "graph": causal.consensus_graph(found["link_frequency"], n), "self_links": causal.strongest_self(found["link_frequency"]), "lag_profiles": causal.top_lag_profiles(found["links"], top)}
    if checked:
        parts = ["frac_mean_drifted", "frac_var_drifted", "frac_corr_drifted", "frac_onset_detected"]
        out |= {
            "ranking": checked["summary"].orderBy(F.desc("anomaly_score"), "run_id"),
            "breakdown": checked["summary"].select("run_id", F.expr(f"stack(4, {', '.join(f"'{p}', {p}" for p in parts)}) as (part, share)")),
            "timeline": drift.propagation(checked["onsets"]),
            "z_bars": drift.z_bars(checked["mean_shift"], top),
            "traces": checked["traces"],
        }
    return out


def report_text(base: Baseline, title: str = "Baseline report", checked: dict[str, DataFrame] | None = None, root_cause: dict | None = None) -> str:
    """Markdown of the baseline's artifacts and, with ``checked``, of a check's findings."""
    found = base.tables
    sections: dict[str, DataFrame | str] = {
        "Runs": run_sizes(found["obs"]).orderBy("run_id"),
        "Data quality": found["quality"].select("run_id", "severity", "max_frac_missing", "n_rules_violated").orderBy("run_id"),
        "Variables": found["pooled_profile"].select("variable", "n", "mean", "std", "min", "max", "n_missing").orderBy("variable"),
        "Frequent alerts": profile.alert_frequency(profile.alerts(found["profile"])),
        "Strongest correlations": correlate.strongest_pairs(found["corr"]),
        "Clusters": found["clusters"].orderBy("cluster_id", "variable"),
    }
    if "links" in found:
        sections["Frequent links"] = causal.top_links(causal.link_frequency(found["links"]))
        sections["Causal search by run"] = found["causal_status"].orderBy("run_id")
    if checked:
        sections["Runs by anomaly"] = checked["summary"].select("run_id", "gate", "anomaly_score", "band", "frac_mean_drifted", "frac_var_drifted", "frac_corr_drifted", "frac_onset_detected").orderBy(F.desc("anomaly_score"), "run_id")
        sections["Largest mean shifts"] = checked["top_mean_drifted"].orderBy("run_id", "rank")
        sections["Most drifted pairs"] = checked["top_pairs"].where("drifted").select("run_id", "var_a", "var_b", "r", "r0", "z_stat").orderBy("run_id", F.desc(F.abs("z_stat")))
        sections["Onsets"] = drift.propagation(checked["onsets"]).select("run_id", "n_detected", "earliest_onset", "earliest_variable", "propagation").orderBy("run_id")
        if "causal_summary" in checked:
            sections["Links that runs agree on"] = checked["causal_summary"]
    if root_cause:
        sections["Likely root cause (an interpretation)"] = "\n".join(f"- {k}: {artifacts.significant(v) if not isinstance(v, (list, dict)) else v}" for k, v in root_cause.items())
    sections["Appendix"] = "Links and correlations describe this run set; they are no proof of cause."
    return artifacts.report(sections, title)


def process_file(spark: SparkSession, path: str, root: str, n_runs: int | None = None, seed: int = 0, t: Thresholds = Thresholds(), **options) -> Baseline:
    """Batch run over one file: load its runs, build every artifact, write the report. Steps and seconds
    are printed."""
    began = time.monotonic()
    runs = ingest.load_runs(spark, path, **options)
    print(f"load: {time.monotonic() - began:.1f} s")
    base = build_baseline(runs.obs, root, n_runs=n_runs, seed=seed, t=t, labels=runs.labels, metadata=runs.metadata, progress=lambda name, k, n: print(f"{k + 1}/{n} {name}"))
    tables.write_text(spark, f"{root.rstrip('/')}/report.md", report_text(base))
    print(f"total: {time.monotonic() - began:.1f} s")
    return base
