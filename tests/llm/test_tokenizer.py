import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terroir.llm import tokenizer

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return tokenizer.encoder(tokenizer.vocabulary_path())


TEXTS = ["", " ", "\n\n  x", "don't we'll", "<|endoftext|>", "été 2021 — 3 €/m²", "日本語テキスト", "🏠🏠 📈", "a" * 5000, "abcd" * 3000, "0123456789" * 500, "\x1c \x1f  x", "===--->>>", "é" * 999, "��", "á" * 50]


def test_ids_equal_exact_merging(own, exact):
    for t in TEXTS:
        assert own.encode(t) == exact.encode_ordinary(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from("aeinrst the<|>=-_0 \n\té")), max_size=80))
def test_any_text(own, exact, text):
    assert own.encode(text) == exact.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text


def test_corpus(spark, sf_dir, exact):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, TEXTS[5], "x"), (3, TEXTS[5], "x"), (4, "z " * 100_000, "x")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode_corpus(df).collect()}
    assert got[1] == [] and got[2] == [] and got[3] == exact.encode_ordinary(TEXTS[5]) and got[4] == exact.encode_ordinary("z " * 100_000)
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    ids = {r["doc_id"]: r["ids"] for r in tokenizer.encode_corpus(docs).collect()}
    assert ids == {k: exact.encode_ordinary(t) if t else [] for k, t in texts.items()}


def test_the_file_is_read_where_the_plan_is_made(spark, tmp_path):
    """Executors get the content: the file may be gone when they run."""
    from pathlib import Path
    from shutil import copyfile

    copyfile(tokenizer.vocabulary_path(), tmp_path / "v.json")
    plan = tokenizer.encode_corpus(spark.createDataFrame([(1, "Un texte."), (2, None), (3, "")], "doc_id long, text string"), str(tmp_path / "v.json"))
    Path(tmp_path / "v.json").unlink()
    e = tokenizer.encoder(tokenizer.vocabulary_path())
    assert {r["doc_id"]: r["ids"] for r in plan.collect()} == {1: e.encode("Un texte."), 2: [], 3: []}
