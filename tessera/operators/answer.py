"""The life of an answer: evidence in, tokens out, then checks. Models are seams; the one here quotes its sources."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evidence

REFUSAL = "The sources hold nothing that answers this."
HINTS = {"summary": "Summarise the sources.", "visual": "Describe what the visual shows.", "critical": "Weigh limits and assumptions.", "general": "Answer from the sources."}


class Model(Protocol):
    def generate(self, messages: list[dict[str, str]]) -> str: ...

    def stream(self, messages: list[dict[str, str]]) -> Iterator[str]: ...


class Extractive:
    """Says the first sentence of each source with its marker."""

    def generate(self, messages: list[dict[str, str]]) -> str:
        return "".join(self.stream(messages))

    def stream(self, messages: list[dict[str, str]]) -> Iterator[str]:
        for block in messages[-1]["content"].split("\n\n"):
            if block.startswith("[S") and "\n" in block:
                head, body = block.split("\n", 1)
                yield f"{body.split('. ')[0].strip().rstrip('.')} {head.split(' ', 1)[0]}. "


@dataclass
class Event:
    kind: str
    text: str = ""
    result: Answer | None = None


@dataclass
class Answer:
    text: str
    used: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    unverified: list[str] = field(default_factory=list)


def prompt(title: str, blocks: list[str], question: str, kind: str, summary: str = "", turns: list[dict[str, str]] | None = None) -> list[dict[str, str]]:
    system = [{"role": "system", "content": "Answer only from the sources and cite them by their markers. Say what the paper states, what you infer, and what is general knowledge."}]
    if summary:
        system.append({"role": "system", "content": f"Earlier: {summary}"})
    user = f"Paper: {title}\n\nSOURCES\n\n" + "\n\n".join(blocks) + f"\n\nQUESTION: {question}\n{HINTS[kind]}"
    return [*system, *(turns or []), {"role": "user", "content": user}]


def ask(spark: SparkSession, question: str, hits: DataFrame, model: Model | None = None, title: str = "", budget: int = evidence.TOKENS) -> Iterator[Event]:
    """Events of an answer from ``hits(place, title, kind, text)``; the sources within ``budget`` come to the driver, no more."""
    model = model or Extractive()
    kind = spark.range(1).select(T.intent(F.lit(question))["kind"]).first()[0]
    yield Event("status", "packing")
    items = hits.withColumn("one", F.lit(1)).withColumn("cost", T.token_estimate(F.col("text")))
    sources = evidence.pack(items, ["one"], budget).orderBy("place").collect()
    if not sources:
        yield Event("done", result=Answer(REFUSAL))
        return
    blocks = [f"[{s['sid']}] {s['title']} ({s['kind']})\n{s['text']}" for s in sources]
    said = ""
    for piece in model.stream(prompt(title, blocks, question, kind)):
        said += piece
        yield Event("token", piece)
    one = spark.createDataFrame([(said, [s["sid"] for s in sources], [s["text"] for s in sources])], "said string, ids array<string>, texts array<string>")
    r = one.select(evidence.validated(F.col("said"), F.col("ids")).alias("v"), evidence.unverified_quotes(F.col("said"), F.col("texts")).alias("q")).first()
    warnings = ([r["v"]["warning"]] if r["v"]["warning"] else []) + [f"Not found in the sources: {q}" for q in r["q"]]
    yield Event("done", result=Answer(r["v"]["text"], r["v"]["used"], warnings, r["q"]))
