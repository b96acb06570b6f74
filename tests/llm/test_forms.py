"""Stored payloads of common size take every form."""

from quillmap.llm import tiff


def test_short_payloads_take_every_form():
    seen = set()
    for k in range(64):
        payload = tiff.padded(b"text %d " % k * (1 + k * 5))
        pages = list(tiff.read(tiff.store(payload)))
        assert b"".join(p["pixels"] for p in pages) == payload and len(pages) == 1
        seen.add((pages[0]["codec"], pages[0]["predictor"], pages[0]["tiled"]))
    assert seen == {(codec, predictor, tile is not None) for codec, predictor, tile, _ in tiff.FORMS}
