"""Questions in words: what they ask for, and what they name."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns of each intent and their weights.
INTENT_PATTERNS = {
    "EVOLUTION": (
        (r"\bchanged?\s+over\s+time\b", 3.0),
        (r"\bcommit\s+history\b", 3.0),
        (r"\bgit\s+history\b", 3.0),
        (r"\bgit\s+log\b", 3.0),
        (r"\brecent\s+commits?\b", 2.5),
        (r"\bcode\s+churn\b", 3.0),
        (r"\bwho\s+(?:modified|wrote|authored|touched|committed)\b", 2.5),
        (r"\bwhen\s+was\s+.*(?:created|modified|added|changed)\b", 2.5),
        (r"\bevolution\s+of\b", 2.5),
        (r"\bhistorical\s+changes?\b", 2.5),
        (r"\bhow\s+has\s+.*(?:changed|evolved)\b", 2.5),
        (r"\brevision\s+history\b", 2.5),
        (r"\bfrequently\s+changed\b", 2.0),
        (r"\bwho\s+last\s+changed\b", 2.5),
        (r"\bco-?chang(?:ed?|ing|es)?\b", 3.0),
        (r"\bchang(?:ed?|ing|es)?\s+together\b", 3.0),
        (r"\blogical\s+coupling\b", 3.0),
        (r"\bcoupled\s+with\b", 2.8),
        (r"\bcoupled\s+files\b", 2.8),
        (r"\bchurn\s+hotspots?\b", 2.5),
        (r"\bmost\s+(?:edited|modified|churned)\b", 2.5),
    ),
    "IMPACT": (
        (r"\b(?:affected|impacted)\s+if\b", 3.0),
        (r"\bif\s+.*(?:is|are)?\s*(?:modified|changed|refactored|deleted|updated)\b", 3.0),
        (r"\bwhat\s+breaks\s+if\b", 3.0),
        (r"\bwhat\s+(?:may|will|could)\s+be\s+(?:affected|impacted)\b", 2.8),
        (r"\bblast\s+radius\b", 3.0),
        (r"\bripple\s+effects?\b", 2.5),
        (r"\bimpact\s+of\s+(?:changing|modifying|updating)\b", 3.0),
        (r"\bconsequences?\s+of\s+(?:changing|modifying)\b", 2.5),
        (r"\bbreakage\b", 2.0),
        (r"\bchange\s+impact\b", 2.8),
        (r"\bwhat\s+breaks\b", 2.5),
        (r"\brisk\s+of\s+modifying\b", 2.5),
    ),
    "INSIGHTS": (
        (r"\barchitecture\s+of\b", 3.5),
        (r"\bexplain\s+.*architecture\b", 3.5),
        (r"\brepository\s+architecture\b", 3.0),
        (r"\barchitecture\s+layer\b", 3.0),
        (r"\bpackage\s+(?:dependency\s+)?cycles?\b", 3.5),
        (r"\bdependency\s+cycles?\b", 3.0),
        (r"\bhighest[- ]risk\b", 3.0),
        (r"\brisk\s+score\b", 3.0),
        (r"\bwhy\s+.*(?:risk\s+score|hotspot)\b", 3.5),
        (r"\bhigh\s+risk\s+score\b", 3.5),
        (r"\bmaintenance\s+risks?\b", 3.0),
        (r"\bhighest\s+(?:maintenance|risk)\b", 3.0),
        (r"\bmaintenance\s+hotspots?\b", 3.0),
        (r"\bcircular\s+dependenc(?:y|ies)\b", 3.0),
        (r"\bcycles?\s+in\b", 2.5),
        (r"\bcycle\s+issues?\b", 2.5),
        (r"\barchitectural\s+(?:risks?|concerns?|flaws?|debt)\b", 2.8),
        (r"\barchitecture\s+conformance\b", 3.0),
        (r"\btechnical\s+debt\b", 2.5),
        (r"\bcode\s+smells?\b", 2.5),
        (r"\bcode\s+health\b", 2.5),
        (r"\bhigh\s+complexity\b", 2.5),
        (r"\bhotspots?\b", 2.5),
        (r"\barchitectural\s+layering\b", 2.5),
        (r"\barchitecture\s+overview\b", 3.0),
        (r"\bmodule\s+hierarchy\b", 3.0),
        (r"\bpackage\s+cycles?\b", 3.0),
        (r"\bpackage\s+level\s+cycles?\b", 3.0),
        (r"\blayer\s+violations?\b", 3.0),
        (r"\blayer\s+conformance\b", 3.0),
        (r"\blayer\s+skipping\b", 3.0),
        (r"\bupward\s+layer\s+leaks?\b", 3.0),
        (r"\bforbidden\s+imports?\b", 3.0),
        (r"\bevidence\s+coverage\b", 3.0),
        (r"\banalysis\s+limitations?\b", 3.0),
        (r"\bconformance\s+index\b", 3.0),
        (r"\baci\b", 2.5),
        (r"\bvolatile\s+fragile\b", 3.0),
        (r"\bbrain\s+modules?\b", 3.0),
        (r"\bshotgun\s+surgery\b", 3.0),
        (r"\bgod\s+class\b", 3.0),
    ),
    "STRUCTURE": (
        (r"\bdepend(?:s|ed|ing)?\s+on\b", 2.5),
        (r"\bdepend(?:ent|ents|ency|encies)\s+of\b", 2.5),
        (r"\bwho\s+(?:calls|invokes|imports|uses)\b", 2.5),
        (r"\bwhat\s+(?:calls|invokes|imports|uses)\b", 2.5),
        (r"\bwhich\s+components?\s+depend\b", 2.8),
        (r"\bcallers?\s+of\b", 2.5),
        (r"\bcallees?\s+of\b", 2.5),
        (r"\b(?:are|is)\s+called\s+by\b", 3.0),
        (r"\bcalled\s+by\b", 3.0),
        (r"\bwhat\s+(?:functions?|methods?|classes?)\s+are\s+called\b", 3.0),
        (r"\b(?:invoked|imported|used)\s+by\b", 2.8),
        (r"\bwhat\s+does\s+.*(?:call|invoke|import)\b", 2.5),
        (r"\bwho\s+inherits\s+from\b", 2.8),
        (r"\binherit(?:s|ed|ing)?\s+from\b", 2.5),
        (r"\bbase\s+class(?:es)?\b", 2.5),
        (r"\bsubclass(?:es)?\b", 2.5),
        (r"\bclass\s+hierarchy\b", 2.5),
        (r"\bcode\s+structure\b", 2.0),
        (r"\bcomponent\s+hierarchy\b", 2.0),
        (r"\bwhere\s+is\s+.*(?:called|used|referenced|imported)\b", 2.5),
        (r"\bwhat\s+imports\b", 2.5),
        (r"\bimports\s+of\b", 2.2),
    ),
    "UNDERSTAND": (
        (r"\bhow\s+(?:does|do|can|is)\b.*\bwork\b", 3.0),
        (r"\bhow\s+(?:is|are)\s+.*implemented\b", 2.8),
        (r"\bwhat\s+(?:does|is)\s+.*do\b", 2.5),
        (r"\bexplain\b", 2.2),
        (r"\bwalk\s+me\s+through\b", 2.5),
        (r"\boverview\s+of\b", 2.2),
        (r"\bpurpose\s+of\b", 2.2),
        (r"\bhow\s+to\s+use\b", 2.0),
        (r"\binner\s+workings?\b", 2.5),
        (r"\bunder\s+the\s+hood\b", 2.5),
        (r"\bhow\s+does\b", 2.0),
        (r"\bworkflow\s+of\b", 2.2),
        (r"\bpipeline\s+of\b", 2.2),
        (r"\bimplementation\s+of\b", 2.2),
    ),
}
#: Intents in the order that decides ties.
INTENTS = ("UNDERSTAND", "STRUCTURE", "IMPACT", "EVOLUTION", "INSIGHTS")
#: Patterns of questions about effects, and about the way something runs; the first kind is tried first.
IMPACT_QUESTIONS = (
    r"\bwho\s+(?:uses|calls|invokes|imports|depends)\b",
    r"\bwhat\s+(?:uses|calls|invokes|imports|depends)\b",
    r"\bdepend(?:s|ed|ing)?\s+on\b",
    r"\bdepend(?:ent|ents|ency|encies)\b",
    r"\bimpact(?:ed|s)?\b",
    r"\bbreak(?:s|ing)?\b",
    r"\bblast\s+radius\b",
    r"\bcaller(?:s)?\b",
    r"\bconsumers?(?:\s+of)?\b",
    r"\bwho\s+references?\b",
    r"\bwhere\s+is\s+.*(?:called|used|referenced|imported)\b",
)
FLOW_QUESTIONS = (
    r"\bhow\s+(?:does|do|can|is)\b",
    r"\bhow\s+to\b",
    r"\bimplement(?:ation|ed|s)?\b",
    r"\bexecution\s+flow\b",
    r"\bflow\s+of\b",
    r"\bpipeline\b",
    r"\bstep(?:s)?\b",
    r"\bprocess(?:ing|es)?\b",
    r"\bhandle(?:s|d|ing)?\b",
    r"\bbuild(?:s|ing)?\b",
    r"\bgenerate(?:s|d|ing)?\b",
    r"\bunder\s+the\s+hood\b",
    r"\binner\s+workings?\b",
    r"\bcall\s+hierarchy\b",
    r"\bsignature(?:s)?\b",
)
#: Words with a capital that name nothing.
NO_NAMES = frozenset(
    "What How Which Explain Where When Who Show Find Check Does Is Are Will Would Could Should If Why Tell Describe Walk List Give Trace Inspect Identify Report "
    "Summarize Compare Analyze Verify Can Please About From With Under Over Before After Between Through Python Git AST RAG API UI CLI JSON HTTP".split()
)
NO_MODULES = frozenset("the this that a an each all and or in of for with to from by our their which what every some any".split())


def retrieval_kind(text):
    """impact, flow or general, as a column."""
    hit = lambda patterns: F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns))
    return F.when(hit(IMPACT_QUESTIONS), "impact").when(hit(FLOW_QUESTIONS), "flow").otherwise("general")


def classify_table(questions: DataFrame, text: str = "query") -> DataFrame:
    """questions with intent, confidence and level; one projection, a sum of matched weights for each intent."""
    q = F.lower(F.coalesce(F.col(text), F.lit("")))
    score = {k: sum((F.when(q.rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in v), F.lit(0.0)) for k, v in INTENT_PATTERNS.items()}
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(score[k].alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(INTENTS)])))
    out = questions.withColumn("_r", ranked)
    s1, s2 = F.col("_r")[0]["s"], F.col("_r")[1]["s"]
    unclear = (s2 > 0) & ((s1 - s2 <= 1.5) | (s2 / s1 >= 0.35) | (s2 >= 2))
    value = (
        F.when(s1 == 0, 0.30).when(unclear, 0.60).when((s1 >= 3) & (s1 - s2 >= 1.5), F.least(F.lit(0.95), 0.75 + 0.05 * s1)).when((s1 >= 2) & (s1 - s2 >= 0.8), 0.80).otherwise(0.55)
    )
    level = F.when(s1 == 0, "LOW").when(unclear, "MEDIUM").when((s1 >= 3) & (s1 - s2 >= 1.5), "HIGH").when((s1 >= 2) & (s1 - s2 >= 0.8), "MEDIUM").otherwise("LOW")
    intent = F.when(s1 == 0, "UNDERSTAND").otherwise(F.col("_r")[0]["name"])
    return out.select(*questions.columns, intent.alias("intent"), F.round(value, 4).alias("confidence"), level.alias("level"), ((s1 > 0) & unclear).alias("is_ambiguous"))


def classify(spark: SparkSession, question: str) -> dict:
    return classify_table(spark.createDataFrame([(question,)], "query string")).first().asDict()


@dataclass
class Entities:
    paths: list[str] = field(default_factory=list)
    methods: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)
    modules: list[str] = field(default_factory=list)

    @property
    def all(self) -> list[str]:
        return [*self.methods, *self.classes, *self.functions, *self.paths, *self.modules]

    @property
    def primary(self) -> str | None:
        return self.all[0] if self.all else None

    @property
    def is_ambiguous(self) -> bool:
        return len(self.all) > 1


def _once(values) -> list[str]:
    return list(dict.fromkeys(values))


def entities(text: str) -> Entities:
    """What a question names, by kind, each once and in order."""
    found = Entities()
    quoted = re.findall(r"[\"'`]([a-zA-Z0-9_\-./\\]+)[\"'`]", text)
    found.paths = _once([x.replace("\\", "/") for x in re.findall(r"\b([a-zA-Z0-9_\-./\\]+\.(?:py|md|txt|json))\b", text)] + [q for q in quoted if "/" in q])
    inside = set(found.paths)
    found.methods = _once(x for x in re.findall(r"\b([A-Z][a-zA-Z0-9]+\.[a-zA-Z0-9_]+)\b", text) if x not in inside)
    parts = {p for m in found.methods for p in m.split(".")}
    pascal = [q for q in quoted if re.fullmatch(r"[A-Z][a-zA-Z0-9]+", q)] + re.findall(r"\b([A-Z][a-z0-9]+(?:[A-Z0-9][a-z0-9]*)+)\b", text)
    found.classes = _once(x for x in pascal if x not in NO_NAMES and x not in parts)
    calls = re.findall(r"\b([a-zA-Z0-9_]+)\(\)", text) + re.findall(r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b", text)
    stems = {w for p in found.paths for w in re.split(r"[./]", p)}
    found.functions = _once(x for x in calls if x not in parts and x not in stems and x not in found.classes)
    named = re.findall(r"\b([a-zA-Z0-9_\-]+)\s+(?:module|component|package|subsystem)\b", text, re.I)
    found.modules = _once(x for x in named if x.lower() not in NO_MODULES)
    return found
