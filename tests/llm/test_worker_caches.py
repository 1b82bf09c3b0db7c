"""A worker holds the caches of one operator at a time."""

from gazeloom.llm import jaccard_trie, shared, token_counts, tokens
from gazeloom.llm.tokens import vocabulary_path


def test_caches_go_with_the_next_operator():
    jaccard_trie.grams(b"some words that are hashed", 3)
    assert len(jaccard_trie._hashes) >= 5
    tokens.encoder(vocabulary_path())
    assert not jaccard_trie._hashes and len(tokens._encoders) == 1
    token_counts.transducer(vocabulary_path("piece_bpe_32k.model"))
    assert not tokens._encoders and len(token_counts._ready) == 1
    shared.alone("jaccard")
    assert not token_counts._ready
