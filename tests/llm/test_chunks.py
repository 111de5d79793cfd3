"""The bounded memory of encoded pieces."""

from staffscope.llm import chunks


def test_a_full_memory_keeps_what_is_asked_now(monkeypatch):
    monkeypatch.setattr(chunks, "REMEMBERED", 3)
    memory = chunks.Memory(chunks.library_tokenizer("word_bpe_49k.json"), chunks.packed, chunks.lower_words, chunks.lower_letters)
    texts = ["one two three four", "four five", "one two, five"]
    plain = [b"".join(row) for row in chunks.Memory(memory._tokenizer, chunks.packed, chunks.lower_words, chunks.lower_letters).encode(texts)]
    learned, learn = [], memory._learn
    monkeypatch.setattr(memory, "_learn", lambda new: learned.append(sorted(new)) or learn(new))
    found = [b"".join(row) for text in texts for row in memory.encode([text])]
    assert found == plain
    assert learned[:2] == [["four", "one", "three", "two"], ["five"]]  # "four" was known and stays so


def test_a_memory_may_be_smaller():
    memory = chunks.Memory(chunks.library_tokenizer("word_bpe_49k.json"), chunks.packed, chunks.lower_words, chunks.lower_letters, remembered=3)
    for text in ("one two three four", "five six", "seven"):
        list(memory.encode([text]))
    assert len(memory._known) <= 3
