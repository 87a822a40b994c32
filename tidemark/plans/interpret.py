"""Evidence for interpretation: small structs per variable, and clients that may read them.

No raw table ever reaches a client: evidence is derived, small and JSON. The only client here is a mock;
others implement ``Client``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import causal, correlate
from ..sources import tables
from ..sources.artifacts import AuditLog, plain

GROUND_RULES = "Use only the evidence given. Name uncertainty. These are hypotheses, not findings."
DISCLAIMER = "Generated interpretation; check it against the tables before acting on it."
RULE_TOOL = {
    "name": "propose_range_rule",
    "description": "Propose an inclusive range for a variable, for a person to confirm.",
    "parameters": {"type": "object", "properties": {"column": {"type": "string"}, "min": {"type": ["number", "null"]}, "max": {"type": ["number", "null"]}, "description": {"type": "string"}}, "required": ["column", "description"]},
}


class Client(Protocol):
    def complete(self, system: str, prompt: str, tools: list | None = None) -> dict: ...


class MockClient:
    """Answers from a table of prepared replies, by the first key that the prompt contains."""

    name = "mock"

    def __init__(self, replies: dict[str, dict] | None = None, supports_tools: bool = True):
        self.replies, self.supports_tools, self.prompts = replies or {}, supports_tools, []

    def complete(self, system: str, prompt: str, tools: list | None = None) -> dict:
        if tools and not self.supports_tools:
            raise NotImplementedError("tools")
        self.prompts.append(prompt)
        return next((r for k, r in self.replies.items() if k in prompt), {"text": "{}"})


#: Makers of clients by provider: from a model's name and a server's address, either of which may be None.
PROVIDERS: dict[str, Callable[[str | None, str | None], Client]] = {"mock": lambda model, base_url: MockClient()}


def client_from_environment(reasoning: bool = False, env: Mapping[str, str] = os.environ) -> Client:
    """The client that ``LLM_PROVIDER`` (mock where unset), ``LLM_MODEL`` and ``LLM_BASE_URL`` name. For
    ``reasoning`` ``LLM_REASONING_MODEL`` goes before ``LLM_MODEL``. Providers but the mock are registered in
    ``PROVIDERS`` by who brings them."""
    provider = env.get("LLM_PROVIDER", "mock").lower()
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}: there are {', '.join(sorted(PROVIDERS))}")
    model = (env.get("LLM_REASONING_MODEL") if reasoning else None) or env.get("LLM_MODEL")
    return PROVIDERS[provider](model, env.get("LLM_BASE_URL"))


def refuse_raw_data(value) -> None:
    """Raises on frames, columns, pandas objects and arrays anywhere inside the evidence."""
    if isinstance(value, (DataFrame, Column)) or type(value).__module__.split(".")[0] in ("pandas", "numpy", "pyarrow"):
        raise TypeError(f"raw data in evidence: {type(value).__name__}")
    if isinstance(value, dict):
        for v in value.values():
            refuse_raw_data(v)
    elif isinstance(value, (list, tuple, set)):
        for v in value:
            refuse_raw_data(v)


def parse_json(text: str | None) -> dict:
    """The first JSON object that begins anywhere in a reply; empty if there is none."""
    decoder, at = json.JSONDecoder(), (text or "").find("{")
    while at >= 0:
        try:
            return decoder.raw_decode(text, at)[0]
        except ValueError:
            at = text.find("{", at + 1)
    return {}


def variable_evidence(profile: DataFrame, corr: DataFrame, clusters: DataFrame | None = None, freq: DataFrame | None = None, partners: int = 5) -> DataFrame:
    """``variable, evidence``: statistics, strongest partners, cluster and degrees as one JSON text."""
    top = correlate.top_partners(corr, partners).groupBy(F.col("var_a").alias("variable")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("var_b").alias("partner"), F.round("r", 4).alias("r")))).alias("partners"))
    stats = [c for c in ("n", "mean", "std", "min", "max", "skewness", "kurtosis", "n_missing", "n_distinct") if c in profile.columns]
    out = profile.select("variable", F.struct(*stats).alias("stats")).join(top, "variable", "left")
    parts = ["stats", "partners"]
    if clusters is not None:
        out = out.join(clusters.select("variable", "cluster_id"), "variable", "left")
        parts.append("cluster_id")
    if freq is not None:
        out = out.join(causal.degrees(freq).select("variable", F.struct("out_degree", "in_degree").alias("degree")), "variable", "left")
        parts.append("degree")
    return out.select("variable", F.to_json(F.struct(*parts)).alias("evidence"))


class Analyst:
    """Sends evidence to a client; every call and every decision is logged."""

    def __init__(self, client: Client, log: AuditLog | None = None, reasoning: Client | None = None):
        self.client, self.log, self.reasoning = client, log, reasoning or client

    def ask(self, task: str, evidence, client: Client | None = None) -> dict:
        refuse_raw_data(evidence)
        client = client or self.client
        reply = client.complete(GROUND_RULES, f"{task}\n{json.dumps(plain(evidence), sort_keys=True)}")
        out = parse_json(reply.get("text", ""))
        if self.log:
            self.log.call(task, evidence, out, getattr(client, "name", type(client).__name__))
        return out

    def identities(self, evidence: DataFrame, known: dict[str, str] | None = None) -> dict:
        rows = {r["variable"]: json.loads(r["evidence"]) for r in evidence.collect()}  # a row per variable
        return self.ask("Name each variable's likely meaning.", {"variables": rows, "known": known or {}})

    def variable_types(self, evidence: DataFrame) -> dict:
        return self.ask("Is each variable measured or manipulated?", {r["variable"]: json.loads(r["evidence"]) for r in evidence.collect()})

    def cluster_roles(self, clusters: DataFrame) -> dict:
        groups: dict[int, list[str]] = {}
        for r in clusters.orderBy("cluster_id", "variable").collect():
            groups.setdefault(r["cluster_id"], []).append(r["variable"])
        return self.ask("What does each cluster of variables do?", groups) if groups else {}

    def root_cause(self, summary: dict, order: list[str], edges: DataFrame) -> dict:
        spark = edges.sparkSession
        chosen = spark.createDataFrame([(v,) for v in order], "variable string")
        rows = [r.asDict() for r in causal.implicated(edges, chosen).orderBy(F.desc("n_runs"), "src", "tgt", "tau").limit(30).collect()]
        return self.ask("Which variable likely started the anomaly?", {"summary": summary, "order": order, "links": rows}, self.reasoning)

    def explain(self, figure: str, data) -> dict:
        return self.ask(f"Explain the figure {figure}.", data)

    def explain_figure(self, name: str, figures: dict[str, DataFrame], rows: int = 50) -> dict:
        """Explains one of ``pipelines.figure_data``'s frames by its first rows."""
        if name not in figures:
            raise ValueError(f"unknown figure: {name}")
        return self.explain(name, [r.asDict(True) for r in figures[name].limit(rows).collect()])

    def chat(self, question: str, context: dict, columns: list[str]) -> dict:
        """One stateless turn; a proposed rule is checked and returned for a person to confirm."""
        refuse_raw_data(context)
        prompt = f"{question}\n{json.dumps(plain(context), sort_keys=True)}"
        try:
            reply = self.client.complete(GROUND_RULES, prompt, [RULE_TOOL])
        except NotImplementedError:
            reply = self.client.complete(GROUND_RULES, prompt)
        pending = None
        call = reply.get("tool_call")
        if call and call.get("name") == RULE_TOOL["name"]:
            pending = make_rule(columns=columns, **call.get("arguments", {}))
        if self.log:
            self.log.call("chat", {"question": question, **context}, {"text": reply.get("text", ""), "rule": pending}, getattr(self.client, "name", ""))
        return {"text": reply.get("text", ""), "pending_rule": pending}


def make_rule(column: str, description: str, columns: list[str], min: float | None = None, max: float | None = None, kind: str = "range") -> dict:
    """A checked rule record; an unknown variable, kind or empty range is an error."""
    if kind != "range":
        raise ValueError(f"unknown kind of rule: {kind}")
    if column not in columns:
        raise ValueError(f"unknown variable: {column}")
    if min is None and max is None:
        raise ValueError("a range needs a bound")
    if min is not None and max is not None and float(min) > float(max):
        raise ValueError("the range is empty")
    return {"rule_id": uuid.uuid4().hex[:12], "variable": column, "type": "range", "min": None if min is None else float(min), "max": None if max is None else float(max), "description": description, "active": True, "created_at": datetime.now(UTC).isoformat()}


class RuleStore:
    """Rules of a baseline in one small JSON file: the driver's, or with a session on any file system that
    Spark reads."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path, spark

    def load(self, active_only: bool = False) -> list[dict]:
        if self.spark is not None:
            text = tables.read_text(self.spark, self.path)
        else:
            try:
                with open(self.path, encoding="utf-8") as f:
                    text = f.read()
            except FileNotFoundError:
                text = None
        return [r for r in json.loads(text or "[]") if r.get("active", True) or not active_only]

    def save(self, rule: dict) -> None:
        self._write([*self.load(), rule])

    def delete(self, rule_id: str) -> None:
        self._write([r for r in self.load() if r["rule_id"] != rule_id])

    def _write(self, rules: list[dict]) -> None:
        text = json.dumps(rules, indent=1)
        if self.spark is not None:
            tables.write_text(self.spark, self.path, text)
            return
        with open(self.path, "w", encoding="utf-8") as f:
            f.write(text)
