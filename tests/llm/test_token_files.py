import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import token_files as T
from lodestone.llm.queries import tokenizer
from lodestone.session import shared_dir


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer())
    made.encode_special_tokens = True
    return made


def test_pieces_give_the_ids_of_whole_texts(reference):
    random.seed(3)
    parts = ["a", " ", "\n", "\t", "'s", "1", "é", ".", " b", "\x1c", "　", "\x85", " ", "​", "\r", "日", "Word,", "<|endoftext|>"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(5000)]
    texts += ["a b\nc. d", "x\n", "\nx", "a\n\nb c", "", None, " ", "don't  stop", "One, two; three.\nFour \"five\""]
    codec = T.Encoder(tokenizer())
    got = codec.encode(texts)
    assert got == [np.array(reference.encode(x or "", add_special_tokens=False).ids, codec.dtype).tobytes() for x in texts]


def test_round_trip(spark, odd, none, reference):
    folder = shared_dir(spark, "test-tokens")
    manifest = T.write_token_files(odd.withColumn("start", F.lit("mine")), folder, tokenizer())
    got = T.read_token_files(manifest, with_ids=True).collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0]))
    start, want = 0, []
    for doc_id, text in rows:
        ids = reference.encode(text or "", add_special_tokens=False).ids + [0]
        data = np.array(ids, "<u4").tobytes()
        want.append((doc_id, start, len(ids), zlib.crc32(data), data))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == [(*w[:4], bytearray(w[4])) for w in want]
    shuffled = T.read_shuffled(manifest, 7).collect()
    assert sorted((r["doc_id"] or -1, bytes(r["ids"])) for r in shuffled) == sorted((w[0] or -1, w[4]) for w in want)
    assert T.token_report(none, shared_dir(spark, "test-tokens"), tokenizer()).count() == 0


def test_damage_is_seen(spark, odd, tmp_path):
    payload = b"some payload"
    data = bytearray(T.frame(payload))
    import io

    assert T.read_frame(io.BytesIO(bytes(data)), "x") == payload
    for at in (0, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            T.read_frame(io.BytesIO(bytes(broken)), "x")
    with pytest.raises(ValueError):
        T.read_frame(io.BytesIO(bytes(data[:-2])), "x")
