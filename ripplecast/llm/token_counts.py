"""Token counts by the whole-token shortcut.

A vocabulary string that the merges rebuild as one token is proved so once, offline, by encoding it alone.  Texts are
then only split into pre-tokens: a proved pre-token counts 1 without any merging, only the rest is merged.
"""

from __future__ import annotations

import json
import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import added

MEMO = 1_000_000  # merged pre-tokens a task remembers; only saves time
# Characters on which the shortcut's own splitting is proved equal to the library's: printable ASCII, tab, line ends,
# Latin-1 letters and signs.  They are their own NFC form, lower-case one by one and have no doubtful white space.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-\xFF]*+")
# The split pattern of the tokenizer file on lower-cased plain text, with the classes written out.
PLAIN_SPLIT = re.compile(r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼½¾]+").findall
WORD_END = "</w>"


# What the file must say for the shortcut to hold: fixed values of the format.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def check_file(path: str) -> None:
    """Refuse a tokenizer whose normalising, splitting or word ends are not those that the shortcut is proved for."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
    held = {
        "normalizer": ((file.get("normalizer") or {}).get("normalizers")) == NORMALIZER,
        "split": [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": SPLIT} and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"],
        "word end": file["model"].get("end_of_word_suffix") == WORD_END,
    }
    if not all(held.values()):
        raise ValueError(f"{path}: another " + ", ".join(k for k, v in held.items() if not v) + " than the shortcut is proved for")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> list[str]:
    """Pre-tokens that are one token: their vocabulary string, merged alone, gives itself."""
    tok, alphabet, out = Tokenizer.from_file(path), byte_alphabet(), []
    for name in tok.get_vocab(with_added_tokens=False):
        if name.endswith(WORD_END) and (body := name[: -len(WORD_END)]) and all(c in alphabet for c in body):
            try:
                plain = bytes(alphabet[c] for c in body).decode()
            except UnicodeDecodeError:
                continue
            if [t.value for t in tok.model.tokenize(body)] == [name]:
                out.append(plain)
    return sorted(out)


class Counter(dict):
    """Tokens of a pre-token: proved ones are there from the start, others are merged when first met."""

    def __init__(self, path: str, proved: list[str]):
        super().__init__(dict.fromkeys(proved, 1))
        self.tok, self.proved = Tokenizer.from_file(path), proved
        self.stand_ins = {b: c for c, b in byte_alphabet().items()}
        self.specials = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.proved) + MEMO:
            self.clear()
            self.update(dict.fromkeys(self.proved, 1))
        n = len(self.tok.model.tokenize("".join(map(self.stand_ins.__getitem__, word.encode()))))
        self[word] = n
        return n

    def piece(self, text: str) -> int:
        if PLAIN.fullmatch(text):
            return sum(map(self.__getitem__, PLAIN_SPLIT(text.lower())))
        # anything else: normalised and split by the library, then the same shortcut
        alphabet = byte_alphabet()
        split = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
        return sum(self[bytes(map(alphabet.__getitem__, w)).decode()] for w, _ in split)

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.piece(text)
        return len(self.special.findall(text)) + sum(map(self.piece, self.special.split(text)))


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes`` (UTF-8) and ``n_tokens``, as the tokenizers library counts them without added tokens.

    A special string inside a text is its one token, as by the library's default.  Null and empty texts have 0 and 0;
    nothing is truncated.  The proof is worked out once and sent along: it has at most one entry per vocabulary string.
    A tokenizer that splits or normalises in another way is refused.
    """
    check_file(path)
    proved = df.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def start():
        counter = Counter(path, proved.value)

        def work(texts):
            values = ["" if t is None else t for t in texts.to_pylist()]
            return [[len(t.encode()) for t in values], [counter.count(t) for t in values]]

        return work

    return added(df, text, keep, "n_bytes long, n_tokens long", start)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import documents

    out = count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
