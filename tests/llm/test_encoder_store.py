"""The store of encoded cuts stays small in every worker."""

from hitledger.llm import packing as P
from hitledger.llm.queries import tokenizer


def test_store_of_cuts_is_bounded_and_ids_stay_the_same():
    e = P.Encoder(tokenizer("byte_bpe_50k.json"))
    for k in range(0, 120_000, 10_000):
        text = " ".join(f"w{n}" for n in range(k, k + 10_000))
        ids = e.encode(text)
        assert len(e.ids) <= 100_000
    assert list(memoryview(ids).cast("I")) == e.tokenizer.encode(text, add_special_tokens=False).ids
