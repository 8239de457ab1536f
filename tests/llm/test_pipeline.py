import os
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from lodestone.llm.bpe import load_ranks
from lodestone.llm.ngram_join import jaccard_components
from lodestone.llm.secrets import base_spans, redact
from lodestone.session import table

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = table(spark, SF, "documents")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    rows = [{r.doc_id: r.asDict() for r in f.collect()} for f in frames]
    assert all(f.columns == docs.columns for f in frames[:-1])
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))  # noqa: B905
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    assert len(rows[1]) >= 0.9 * len(rows[0]) - len(toxic)
    # One of each component of what came in, the smallest.
    assert set(rows[2]) == {r.component_id for r in jaccard_components(frames[1]).collect()}
    norm = lambda x: " ".join(re.sub(r"[^\w\s]", "", x.lower()).split())
    items = [norm(r.text) for r in table(spark, SF, "benchmark").collect()]
    assert not any(i in norm(r["text"]) for r in rows[3].values() for i in items if len(i.split()) >= 12)
    assert {k for k, r in rows[2].items() if any(i in norm(r["text"]) for i in items)} >= set(rows[2]) - set(rows[3])
    assert {k: r["text"] for k, r in rows[4].items()} == {k: redact(r["text"]) for k, r in rows[3].items()}
    assert not any(base_spans(r["text"]) for r in rows[4].values()) and all(r["n_chars"] == len(r["text"]) for r in rows[4].values())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {k: r["ids"] for k, r in rows[5].items()} == {k: library.encode_ordinary(r["text"]) for k, r in rows[4].items()}


def test_run_gives_the_last_stage(spark):
    assert os.path.exists(SF) and corpus_pipeline.run(spark, SF).columns == ["doc_id", "ids"]
