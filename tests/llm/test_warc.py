import json

import pytest
from pyspark.sql import functions as F

from lodestone.llm import warc as W
from lodestone.session import shared_dir

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><meta name="author" content="me"><style>p{}</style></head>
<body><!-- <a href="/hidden">x</a> --><p>One <b>two</b></p><div>three<br>four &lt;</div><a href='/next'>next</a><img src=pic.png></body></html>"""


def test_text_and_metadata():
    assert W.plain_text(PAGE) == "One two\nthree\nfour <\nnext"
    info = W.page_metadata(PAGE)
    assert info["title"] == "A & B" and info["metas"] == [{"name": "author", "content": "me"}]
    assert info["links"] == [{"path": "A@/href", "url": "/next"}, {"path": "IMG@/src", "url": "pic.png"}]


def test_derivatives_refer_to_their_source():
    response = W.response_record(5, "http://a.example/x y", PAGE)
    source, block = W.parse_record(response)
    made = {kind: W.parse_record(data) for kind, _, _, _, data in W.derive(response)}
    assert set(made) == {"metadata", "conversion"}
    for kind, (headers, own) in made.items():
        assert headers["WARC-Type"] == kind and headers["WARC-Refers-To"] == source["WARC-Record-ID"]
        assert headers["WARC-Target-URI"] == source["WARC-Target-URI"] == "http://a.example/x%20y"
        assert headers["WARC-Source-Payload-Digest"] == source["WARC-Payload-Digest"] == W.digest(PAGE.encode())
        assert headers["WARC-Block-Digest"] == W.digest(own) and int(headers["Content-Length"]) == len(own)
    envelope = json.loads(made["metadata"][1])
    assert envelope["Source"]["Headers"] == source and envelope["HTTP"]["Status"] == "HTTP/1.1 200 OK"
    assert envelope["HTTP"]["Headers"]["Content-Type"] == "text/html; charset=utf-8"
    assert made["conversion"][1].decode() == W.plain_text(PAGE)


@pytest.mark.parametrize("bad", [b"", b"no record", W.response_record(1, "u", "text")[:-8], W.response_record(1, "u", "text").replace(b"text\r\n", b"tent\r\n")])
def test_damaged_responses_give_an_error_record(bad):
    ((kind, _, _, _, data),) = W.derive(bad)
    assert kind == "metadata" and json.loads(W.parse_record(data)[1])["error"]


def test_files(spark):
    rows = [(1, "http://a", PAGE), (1, "http://a", PAGE), (2, None, None), (None, "http://b", ""), (3, "http://c", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("record", F.lit("mine")).repartition(3)
    index = W.build_derivatives(W.response_records(pages), shared_dir(spark, "test-warc"))
    got = W.read_derivatives(index).collect()
    assert len(got) == 10 and sorted(r["type"] for r in got) == ["conversion"] * 5 + ["metadata"] * 5
    assert all(r["refers_to"] and r["source_payload_digest"] for r in got)
    texts = sorted(r["block"] for r in got if r["type"] == "conversion")
    assert texts == sorted([W.plain_text(PAGE)] * 2 + ["", "", "x" * 200_000])
    assert W.read_derivatives(W.build_derivatives(W.response_records(pages.limit(0)), shared_dir(spark, "test-warc"))).count() == 0
