import glob
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldloom.llm import common, queries, token_files
from foldloom.llm.token_files import EliasFano, TokenFile, pack
from tests.llm.conftest import ODD, SMALL, small_documents

PATH = queries.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.one_of(st.integers(0, 1 << 62), st.integers(0, 1000)), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    made, rest = EliasFano.read(memoryview(EliasFano.of(np.array(values, np.uint64)).to_bytes() + b"more"))
    assert bytes(rest) == b"more" and made.select(np.arange(len(values))).tolist() == values
    for i in {0, len(values) // 2, len(values) - 1} & set(range(len(values))):
        assert made.select(np.array([i])).tolist() == [values[i]]
    assert made.select(np.arange(0, len(values), 7)).tolist() == values[::7]


def test_near_minimal_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(EliasFano.of(ends).to_bytes()) < 10_000 * (2 + np.log2(ends[-1] / 10_000)) / 8 * 1.1


def test_file_round_trip():
    docs, ids = [None, -4, 0, 0, 9], [np.arange(k, dtype="<u4") for k in (3, 0, 5, 1, 2)]
    for size in (50_257, 70_000):
        file = TokenFile(pack(docs, ids, size))
        assert [(d, x.tolist()) for d, x in map(file.document, range(5))] == [(d, x.tolist()) for d, x in zip(docs, ids, strict=True)]
        assert file.documents(0, 5)[0] == docs and file.documents(2, 4)[1].tolist() == [3, 8, 9]


def wanted(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for doc, text in rows:
        ids = np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((str(doc), start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out)


def test_query(spark):
    got = [(str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_files(spark, SMALL).collect()]
    assert sorted(got) == wanted(small_documents())


def test_many_files_and_odd_rows(spark, odd, empty, tmp_path):
    folder = str(tmp_path / "f")
    token_files.write(odd, PATH, folder, file_ids=20)
    got = [(str(r.doc_id), r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_files.read(spark, folder).collect()]
    assert sorted(got) == wanted(ODD)
    assert token_files.read(spark, token_files.write(empty, PATH, str(tmp_path / "e"))).collect() == []
    # A file is read alone, without Spark.
    paths = sorted(glob.glob(f"{folder}/file=*/*.txt"))
    assert len(paths) > 4
    alone = [TokenFile.open(p) for p in paths]
    rows = [file.document(i) for file in alone for i in range(file.n)]
    assert sorted((str(d), zlib.crc32(x.astype("<u4").tobytes())) for d, x in rows) == sorted((d, c) for d, _, _, c in got)
    assert [d for d, _ in rows] == sorted((d for d, _ in ODD), key=lambda d: (d is not None, d or 0))


def test_long_texts(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(("one", "two", "é", "3")) for _ in range(n))) for k, n in enumerate((1_000_000, 3, 400_000, 0))]
    folder = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH, common.shared_dir(spark) + "/f", file_ids=300_000)
    got = [(str(r.doc_id), r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_files.read(spark, folder).collect()]
    assert sorted(got) == wanted(rows)
