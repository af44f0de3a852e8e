"""Token ids of whole texts through a table of distinct words.

Splitting texts into words that a tokenizer never looks across makes its output the words'
outputs in order. Each worker splits its texts, encodes every distinct word once with the real
tokenizer, and joins the ids back by position. Texts for which a split is not known to be safe
are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from tokenizers import Tokenizer

#: Words remembered by a worker at most; then its table starts anew.
TABLE_WORDS = 400_000
#: Longer words are encoded but not remembered.
LONGEST_WORD = 256
#: Letters of texts whose words are looked up together.
BATCH_LETTERS = 2_000_000

#: The characters of texts that are split here: ASCII, Latin letters and common punctuation. On
#: these, Python and the tokenizers' patterns agree about letters, digits and white space, and
#: normalisation changes nothing. A text with any other character is encoded whole.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_SPACE = "\t\n\r "
_PLAIN = re.compile(f"[{_SPACE}!-~¡-¬®-±´-¸º»¿-ɏ‐-―‘-‟…€]*")
_CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"
_OTHER = f"[^{_SPACE}{_LETTER}0-9]"


@dataclass(frozen=True)
class Splitter:
    """The words of a plain text, as the tokenizer itself normalises and splits it."""

    words: re.Pattern
    lower: bool

    def split(self, text: str) -> list[str] | None:
        """None for a text that must be encoded whole."""
        if "<|" in text or not _PLAIN.fullmatch(text):
            return None
        return self.words.findall(text.lower() if self.lower else text)


BYTE_LEVEL = Splitter(
    re.compile(f" ?[{_LETTER}]+| ?[0-9]+|{_CONTRACTION}| ?{_OTHER}+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"), False
)
SPACED = Splitter(re.compile(f"[{_LETTER}]+|[0-9]|{_CONTRACTION}|{_OTHER}+"), True)


def shown_bytes() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the others in order from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(hidden)}


_SHOWN = str.maketrans({chr(b): c for b, c in shown_bytes().items()})


class WordTable:
    """Distinct words with what ``made`` gives for their ids (a list); each is encoded once.

    A word is what the tokenizer hands to its model, so the model alone encodes it, in the
    characters that stand for its bytes.
    """

    def __init__(self, path: str, splitter: Splitter, made: Callable[[list[int]], object]):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.splitter = splitter
        self.made = made
        self.table: dict[str, object] = {}

    def _whole(self, text: str) -> object:
        return self.made(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> object:
        plain = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        return self.made([t.id for t in self.model.tokenize(plain)])

    def parts(self, texts: list[str | None]) -> Iterator[list[object]]:
        """For each whole text, in order, what ``made`` gave for each of its words."""
        at = 0
        while at < len(texts):
            split: list[list[str] | str] = []
            size = 0
            while at < len(texts) and size < BATCH_LETTERS:
                text = texts[at] or ""
                size += len(text)
                words = self.splitter.split(text)
                split.append(text if words is None else words)
                at += 1
            if len(self.table) > TABLE_WORDS:
                self.table.clear()
            table = self.table
            new = set().union(*[x for x in split if isinstance(x, list)]).difference(table)
            for word in new:
                table[word] = self._word(word)
            for words in split:
                yield [self._whole(words)] if isinstance(words, str) else [table[w] for w in words]
            for word in new:
                if len(word) > LONGEST_WORD:
                    del table[word]


def byte_pieces(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; special tokens are their own text."""
    byte_of = {c: b for b, c in shown_bytes().items()}
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    pieces = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for piece, at in tokenizer.get_vocab(with_added_tokens=True).items():
        pieces[at] = added[at].encode() if at in added else bytes(byte_of[c] for c in piece)
    return pieces
