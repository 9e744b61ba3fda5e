"""Media columns against the payload computed plainly."""

import hashlib
import zlib

from tremor.llm import jpeg


def test_media_columns(docs, none):
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    got = jpeg.media_columns(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        ok = False
        for text in texts[r.doc_id]:
            raw = (text or "").encode()
            payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            ok |= (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert ok, r.doc_id
        by.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by.values())
    assert jpeg.media_columns(none).count() == 0
