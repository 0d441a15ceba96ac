"""That nothing is cut, lost or merged on the way: unlucky sketches, added tokens, large groups of copies."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe_ids, near_dedup


def test_unlucky_pair_of_near_duplicates(spark):
    shared = " ".join(f"w327595x{k}" for k in range(8))  # 8 of 10 words shared, and coarse sketches that estimate 0.605
    docs = spark.createDataFrame([(1, f"{shared} p327595"), (2, f"{shared} q327595")], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs, shingle=1).orderBy("doc_id").collect()] == [(1, 1), (2, 1)]


def test_ids_of_texts_with_added_tokens():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe_ids.encoder(path, public_tokenizers.PATTERN)
    end = "<|endoftext|>"
    assert bpe_ids.encode(own, f"a {end} b").tolist() == [64, 220, 50256, 275]
    for t in (end, end * 3, f" {end}\n\n{end} ", f"<|{end}", "<|endoftext|", f"ä{end[:-1]}{end}", f"{'many words ' * 2000}{end}x"):
        assert bpe_ids.encode(own, t).tolist() == library.encode(t, add_special_tokens=False).ids, t[-40:]
    assert bpe_ids.encode(own, end, 2).tolist() == [50256, 2] and bpe_ids.encode(own, end, 2).dtype == np.dtype("<u4")


def test_group_of_copies_with_a_third_of_a_host(spark, sf_dir):
    copy = "\n".join(f"sentence {k} of the page that was copied" for k in range(5))
    texts = [f"menu of the site\n{copy}"] * 30 + [f"menu of the site\nown page {i} with its words a{i} b{i} c{i}" for i in range(60)] + [None] * 5
    docs = spark.createDataFrame([(i, t, "en", "host", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    clean = corpus_pipeline.lines(spark, docs, sf_dir)
    got = {r.doc_id: r for r in clean.collect()}
    assert all(got[i].text == copy and got[i].n_chars == len(copy) for i in range(30))
    assert all(got[i].text == texts[i].split("\n")[1] for i in range(30, 90)) and got[90].text is None
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, clean, sf_dir).where("doc_id < 30").collect()] == [0]
