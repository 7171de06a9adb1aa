import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from hopline.llm import bpe, mixing, toxicity
from tests.llm.scopes import redacted
from tests.llm.test_mixing import WORD, brute_targets
from tests.llm.test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark, tmp_path, docs):
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "encoding"]
    held, frame = [docs], docs
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, frame, SF).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        held.append(frame)
        if i < len(C.STAGES) - 1:
            assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
    all_rows, clean, single, safe, mixed, coded = ([r.asDict() for r in f.collect()] for f in held)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r["doc_id"] for r in toxicity.predict(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in all_rows} - rejected
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    known = {r["doc_id"] for r in labels.where("toxic = 0").collect()} & {r["doc_id"] for r in all_rows}
    assert len(known & rejected) <= 0.1 * len(known) and toxic

    roots = brute_components({brute_print(r["text"]) for r in clean})
    least = {}
    for r in clean:
        root = roots[brute_print(r["text"])]
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in single) == sorted(least.values())

    by_id = {r["doc_id"]: r for r in single}
    for r in safe:
        text = by_id[r["doc_id"]]["text"]
        assert r["text"] == redacted(text) and (r["n_chars"] == len(r["text"]) or r["text"] == text)
    assert len(safe) == len(single)

    sizes, taken = Counter(), Counter()
    for r in safe:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    for source, goal in brute_targets(sizes).items():
        assert abs(taken[source] - goal) <= 2 * mixing.BLOCK

    ranks = bpe.read_ranks(None, P.path(C.TOKENIZER))
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r["doc_id"], reference.encode_ordinary(r["text"])) for r in mixed)
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in coded) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in coded)

    again = sorted((r["doc_id"], bytes(r["ids"])) for r in C.run(spark, SF).collect())
    assert again == sorted((r["doc_id"], bytes(r["ids"])) for r in coded)


def test_stages_on_odd_and_empty_documents(spark, odd_docs):
    frame, empty = odd_docs, odd_docs.limit(0)
    for i, (name, stage) in enumerate(C.STAGES):
        frame, empty = stage(spark, frame, SF), stage(spark, empty, SF)
        if i < len(C.STAGES) - 1:
            assert frame.dtypes == odd_docs.dtypes
            assert empty.dtypes == odd_docs.dtypes
        assert frame.count() > 0 and empty.count() == 0
    assert re.fullmatch("doc_id,lang,source,n_tokens,ids", ",".join(frame.columns))
