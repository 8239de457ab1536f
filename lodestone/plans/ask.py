"""Answers from retrieved evidence: a threshold, a prompt, a model, citations, and what the retrieval did.

A model is a callable from a prompt to an answer. ``evidence_model`` is one without a network: it answers from the evidence
block alone, or says that the evidence does not suffice. Evidence is a few rows a question, so each prompt is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import vector as V

MIN_SCORE = 0.15
TOP_K = 4
#: What an answer without enough evidence says, and the tail of a prompt.
INSUFFICIENT = "Insufficient context in repository to answer this question accurately."
NOTHING_FOUND = INSUFFICIENT + " No relevant code or documentation was found."
ASK = "Provide an accurate, grounded answer with inline citations in the format [relative/path.py:start_line-end_line]."
#: Words of a question that say nothing about its subject.
PLAIN_WORDS = (
    "how", "what", "where", "when", "which", "does", "implemented", "defined", "work", "show", "tell", "explain", "code", "file", "from", "with", "this", "that", "into", "have",
)
TAGGED = re.compile(r"--- Evidence #\d+ \[([^\]\s]+:\d+-\d+)\](?: \(([A-Z_]+: [^)]+)\))?")


def make_prompt(question: str, evidence: str) -> str:
    return f"Developer Question:\n{question}\n\nRetrieved Codebase Evidence:\n{evidence}\n\n{ASK}\n"


def evidence_model(prompt: str) -> str:
    """The first two pieces of evidence as the answer, if the question shares the beginning of a word with the evidence."""
    asked, _, evidence = prompt.partition("\n\nRetrieved Codebase Evidence:\n")
    words = lambda x: set(re.findall(r"\b[a-zA-Z]{3,}\b", x.lower()))
    wanted = words(asked.partition("\n")[2]) - set(PLAIN_WORDS)
    heads = {w[:4] for w in words(evidence)}
    # Words of three letters stand for all that begin with them, on either side.
    near = lambda w: any(h.startswith(w[:4]) or w.startswith(h) for h in heads)
    if wanted and not any(map(near, wanted)):
        return NOTHING_FOUND
    found = TAGGED.findall(evidence)
    if not found:
        return INSUFFICIENT
    place = lambda k: found[k][0].replace("\\", "/")
    lines = [
        f"Based on the repository code in [{place(0)}], the requested functionality is implemented as follows:",
        "",
        f"1. Primary definition: {found[0][1] or 'relevant block'} is defined at [{place(0)}].",
    ]
    if len(found) > 1:
        lines.append(f"2. Related context: {found[1][1] or 'supporting code'} is located at [{place(1)}].")
    return "\n".join(lines)


def retrieval_metadata(results: DataFrame) -> DataFrame:
    """Per query_id: n_sources, n_seeds, n_expanded, and the relationships that the graph went by."""
    relation = F.col("relationship")
    return results.groupBy("query_id").agg(
        F.count("*").alias("n_sources"),
        F.count(F.when(relation.isNull(), 1)).alias("n_seeds"),
        F.count(F.when(relation.isNotNull(), 1)).alias("n_expanded"),
        F.array_sort(F.collect_set("relationship")).alias("relationships"),
    )


def ask(questions: DataFrame, results: DataFrame, model: Callable[[str], str] = evidence_model, min_score: float = MIN_SCORE) -> DataFrame:
    """Per question (query_id, question): answer, citations, is_sufficient, n_sources, n_seeds, n_expanded, relationships.

    results: query_id, rank, score, relative_path, start_line, end_line, chunk_type, symbol_name, signature, content, relationship;
    TOP_K rows a question or so. An empty question, no result, and a best score under min_score are answered without the
    model; an error of the model is the answer; an answer without tags cites the best result.
    """
    block = V.evidence_block(
        F.col("rank"), F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_type"), F.col("symbol_name"), F.col("relationship"), F.col("score"), F.col("signature"), F.col("content")
    )
    tag = F.format_string("%s:%d-%d", "relative_path", "start_line", "end_line")
    gathered = results.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n").alias("evidence"),
        F.max("score").alias("best"), F.min_by(tag, "rank").alias("first"),
    )
    rows = questions.select("query_id", F.trim(F.coalesce("question", F.lit(""))).alias("question")).join(gathered, "query_id", "left").join(retrieval_metadata(results), "query_id", "left")
    enough = (F.col("question") != "") & (F.coalesce("best", F.lit(0.0)) >= min_score)

    @F.pandas_udf("string")
    def answered(question, evidence):
        def one(q, e):
            try:
                return model(make_prompt(q, e))
            except Exception as error:  # noqa: BLE001  what a model raises is its own
                return f"Error generating answer from LLM provider: {error}"

        return question.combine(evidence, one)

    # The model sees only questions with enough evidence.
    told = rows.where(enough).withColumn("answer", answered("question", "evidence"))
    plain = rows.where(~enough).withColumn("answer", F.when(F.col("question") == "", "Please provide a valid non-empty question.").otherwise(NOTHING_FOUND))
    bad = F.contains(F.lower("answer"), F.lit("insufficient context")) | F.startswith("answer", F.lit("Error generating answer"))
    tags = V.citations(F.col("answer"))
    cited = F.when(bad, F.array().cast("array<string>")).when(F.size(tags) == 0, F.array("first")).otherwise(tags)
    out = told.withColumn("is_sufficient", ~bad).withColumn("citations", cited)
    out = out.unionByName(plain.withColumn("is_sufficient", F.lit(False)).withColumn("citations", F.array().cast("array<string>")))
    return out.select(
        "query_id", "answer", "citations", "is_sufficient", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sources", "n_seeds", "n_expanded")],
        F.coalesce("relationships", F.array().cast("array<string>")).alias("relationships"),
    )
