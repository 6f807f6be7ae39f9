"""Credentials embedded in source code (problem 6).

A dictionary of the words that identifiers of the whole corpus consist of is counted first. Literals in assignment
contexts (key and value, headers, connection strings, URLs, name and value pairs, comments) are then segmented into
dictionary words by Viterbi; what no word, separator or trailing number explains is the residual. A value whose residual
is long is a secret unless it has a known format of hashes, ids or public data; under a key that names a password an
explained value with a digit or sign counts too, blanks included, and a passphrase of words. Placeholders and references never count. Values have any length; a
literal that is no secret is searched for pairs within it.

Redaction replaces the characters of the secrets and nothing else; line breaks within private keys stay.

Defined results: null and empty texts hold nothing; a secret that occurs several times in a chunk is one row; rows with
equal id count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokenize import text_slices
from corpusloom.session import spread

#: Most frequent words kept as the dictionary (a documented bound of the model), and their least length.
VOCABULARY, WORD_LETTERS, LONGEST = 30_000, 3, 20
#: Unexplained characters that make a value a secret: under a key that names one, and under any key.
RESIDUAL_NAMED, RESIDUAL_ANY = 8, 14
#: The same for a password of letters only, and for one in upper case in an address (not USER:PASSWORD).
RESIDUAL_LETTERS, RESIDUAL_UPPER = 6, 4
#: Signs that prose has too.
_prose = str.maketrans("", "", " .,!?'’:;()")

_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_private = re.compile(r"-----BEGIN[ \t]+(?:[A-Z0-9]+[ \t]+)*PRIVATE[ \t]+KEY(?:[ \t]+BLOCK)?-----.*?-----END[ \t]+(?:[A-Z0-9]+[ \t]+)*PRIVATE[ \t]+KEY(?:[ \t]+BLOCK)?-----", re.S | re.I)
_public = re.compile(r"-----BEGIN[ \t]+(?:[A-Z0-9]+[ \t]+)*(?:PUBLIC[ \t]+KEY|CERTIFICATE(?:[ \t]+REQUEST)?)-----.*?(?:-----END[^\n]*?-----|\Z)", re.S | re.I)
_pair = re.compile(
    r"""(?P<key>[A-Za-z_][\w.\-]*)["'`]?[ \t]*(?::=|=>|=|:)[ \t]*(?:(?P<q>["'`])(?P<a>(?:(?!(?P=q))[^\n\\]|\\.){6,}+)(?P=q)|(?P<b>[^\s"'`,;(){}\[\]<>]{6,}))"""
)
_named = re.compile(r"""(?i)\bname:[ \t]*["']?(?P<key>[\w.\-]+)["']?[ \t]*\r?\n\s*value:[ \t]*(?:(?P<q>["'])(?P<a>[^\n]*?)(?P=q)|(?P<b>\S+))""")
_role = re.compile(r"""(?i)\b(?:ROLE|USER)\s+["'`]?(?P<key>\w+?)["'`]?\s+(?:WITH\s+)?(?:LOGIN\s+)?(?:ENCRYPTED\s+)?(?:PASSWORD|IDENTIFIED\s+BY)\s+'(?P<a>[^'\n]+)'""")
_userinfo = re.compile(r"""(?i)\b[a-z][a-z0-9+.\-]*://[^\s:/@"'`<>]*:(?P<a>[^\s@/"'`<>]+)@[\w.\-\[]""")
_connection = re.compile(r"""(?i)\b(?:server|data source|host|addr(?:ess)?|database|user id|uid)=[^"'`\n]*?\b(?:password|pwd)=(?P<a>[^;"'`\n]+)""")
_hook = re.compile(r"""(?i)https?://[^\s/"'`]+/services/[A-Z0-9]{6,}/[A-Z0-9]{6,}/(?P<a>[A-Za-z0-9]{16,})""")
_basic_user = re.compile(r"""(?i)(?:^|\s)(?:-u|--user)[ =]["']?[^\s:"']+:(?P<a>[^\s"']{6,})""")
_header = re.compile(r"""(?i)\b(?:bearer|basic)[ \t]+(?P<a>[A-Za-z0-9+/=_.~\-]{12,})""")
_access_id = re.compile(r"(?i)(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")

_labels = re.compile(r"(?i)(?:^|_)(?:label|name|hint|title|text|message|msg|prompt|policy|length|len|count|limit|size|min|max|ttl|expiry|timeout|field|column|type|kind|path|file|dir|enabled|required|id|ids|url|uri|host|format|regex|pattern|header_name|placeholder)$")
_password = re.compile(r"(?i)pass(?:w(?:or)?d|phrase|_phrase|code)?(?:$|_|\d)|(?:^|_)pw(?:$|_)|pwd|passwd|password|passphrase")
_tokens = re.compile(r"(?i)secret|token|api_?key|apikey|access_?key|private_?key|signing|auth|cred(?:ential)?s?(?:$|_)|bearer|session_?key|encryption_?key|(?:^|_)key$|salt$")
_hashes = re.compile(r"(?i)sha\d*(?:$|_)|checksum|digest|integrity|commit|(?:^|_)hash|etag|fingerprint|md5|uuid|guid|request_?id|trace_?id|correlation|revision|icon|image|logo|font|public_?key|certificate|(?:^|_)cert(?:$|_)|thumbprint|version|nonce_?id|build_?id|object_?id")
_uuid = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_hex = re.compile(r"(?i)[0-9a-f]+")
_solid = re.compile(r"[A-Za-z0-9+/=_.~\-]+")
_formats = re.compile(r"(?i)(?:sha(?:1|224|256|384|512)|md5)[-:]|data:|ssh-(?:rsa|ed25519|dss) |\$2[aby]\$|0x[0-9a-f]+$|https?://|[a-z][a-z0-9+.\-]*://|\.{0,2}/")
_placeholder = re.compile(
    r"(?i)\$\{|\$\(|\{\{|<[^>]*>|%\(|%[A-Z_]+%|^\$[A-Z_]|^[*x.\-#?]{3,}$|^x{4,}|\*{3,}|change_?me|redacted|placeholder|^(?:your|my|the|some|insert|enter|replace)[-_ ]|example|dummy|^todo|not[-_ ]?(?:set|a[-_ ]real)|^(?:none|null|nil|true|false|undefined|empty|password|secret|token|passw0rd|test|user|username|hidden|masked|unset)$|vault[:_/]|^(?:os\.|process\.|env[.\[:(]|getenv|config\.|settings\.|var\.|local\.|data\.|module\.|secrets?\.|ref\+|arn:|ssm:|op://)"
)


def word_counts(rows: DataFrame, most: int = VOCABULARY) -> list[tuple[str, int]]:
    """The most frequent words of all texts with their counts; at most MOST rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in text_slices(batches, 0):
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(_word.findall(text))
            if len(total) > 200_000:
                yield from flush(total)
                total = Counter()
        yield from flush(total)

    def flush(total: Counter) -> Iterator[pa.RecordBatch]:
        low: Counter[str] = Counter()
        for w, n in total.items():
            if WORD_LETTERS <= len(w) <= LONGEST:
                low[w.lower()] += n
        if low:
            yield pa.RecordBatch.from_arrays([pa.array(low.keys(), pa.string()), pa.array(low.values(), pa.int64())], names=["word", "n"])

    words = rows.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 3")
    return [(r[0], r[1]) for r in words.orderBy(F.desc("n"), "word").limit(most).collect()]


class Segmenter:
    """Viterbi segmentation of a literal into dictionary words, separators, trailing numbers and unexplained characters."""

    def __init__(self, counts: list[tuple[str, int]]) -> None:
        total = sum(n for _, n in counts) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts}
        self.longest = max((len(w) for w in self.cost), default=0)

    #: Cost of an unexplained character: about log(64).
    CHARACTER = 4.2

    def residual(self, value: str) -> int:
        """How many characters stay unexplained."""
        low, n = value.lower(), len(value)
        best = [0.0] * (n + 1)
        left = [0] * (n + 1)  # unexplained on the best path
        ends_word = [True] + [False] * n
        for i in range(1, n + 1):
            c = low[i - 1]
            if not c.isalnum():
                cost, add = 1.0, 0 if ends_word[i - 1] or (i > 1 and not low[i - 2].isalnum()) else 1
            else:
                cost, add = self.CHARACTER, 1
            b, u, w = best[i - 1] + cost, left[i - 1] + add, not c.isalnum() and not add
            if c.isdigit() and (i == n or not low[i].isalnum()):
                j = i - 1
                while j and low[j - 1].isdigit():
                    j -= 1
                if i - j <= 4 and ends_word[j] and best[j] + 3.0 < b:
                    b, u, w = best[j] + 3.0, left[j], True
            for k in range(WORD_LETTERS, min(self.longest, i) + 1):
                cost = self.cost.get(low[i - k : i])
                if cost is not None and best[i - k] + cost < b:
                    piece = value[i - k : i]
                    if piece.islower() or piece.isupper() or piece[0].isupper() and piece[1:].islower():
                        b, u, w = best[i - k] + cost, left[i - k], True
            best[i], left[i], ends_word[i] = b, u, w
        return left[n]


def is_secret(key: str, value: str, quoted: bool, plain: bool, seg: Segmenter) -> bool:
    """Whether VALUE under KEY is a secret. plain: unquoted values are literals in this language."""
    if len(value) < 6:
        return False
    bare = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key).lower().replace("-", "_").replace(".", "_").strip("_")
    if _hashes.search(bare):
        return False
    password, token = _password.search(bare), _tokens.search(bare)
    if " " in value and not (password and quoted):
        return False
    if _labels.search(bare) and not bare.endswith("access_key_id"):
        return False
    if not (password or token) and not _solid.fullmatch(value):  # before the costly checks: an unquoted run may hold many pairs
        return False
    if _placeholder.search(value) or _formats.match(value) or _uuid.fullmatch(value):
        return False
    if password:
        if not (quoted or plain):
            return False
        sign = any(c.isdigit() or not (c.isalnum() or c in "_-.") for c in value.translate(_prose))
        if " " in value and not sign:  # words alone are a passphrase only where the key says so
            return "phrase" in bare and len(value.split()) > 3 and value.islower()
        if not sign:  # letters only: what the dictionary does not explain
            return seg.residual(value) >= RESIDUAL_LETTERS
        return (seg.residual(value) > 0 or value != bare) and not re.fullmatch(r"[a-z_]+\(.*|[\w.]+\(.*", value)
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    if not mixed and not (token and len(value) >= 20):
        return False
    left = seg.residual(value)
    if token:
        return left >= RESIDUAL_NAMED and (quoted or plain or left >= RESIDUAL_ANY) and left >= 0.4 * len(value)
    if _hex.fullmatch(value) or value.count("/") > 3 and "." in value:
        return False
    return left >= RESIDUAL_ANY and left >= 0.6 * len(value)


_PLAIN = {"env", "ini", "yml", "yaml", "properties", "toml", "conf", "cfg", "tf", "sh", ""}


def secrets_of(text: str, language: str | None, seg: Segmenter) -> list[tuple[int, int]]:
    """Spans of the secrets of a text."""
    if not text:
        return []
    spans: list[tuple[int, int]] = [m.span() for m in _private.finditer(text)]
    taken = spans + [m.span() for m in _public.finditer(text)]
    plain = (language or "").lower() in _PLAIN

    def free(a: int, b: int) -> bool:
        return all(b <= s or a >= e for s, e in taken)

    def add(a: int, b: int) -> None:
        if a < b and free(a, b):
            spans.append((a, b))
            taken.append((a, b))

    for rx in (_userinfo, _connection, _basic_user):
        for m in rx.finditer(text):
            value = m.group("a")
            if not _placeholder.search(value) and len(value) >= 4 and not (value.isupper() and seg.residual(value) < RESIDUAL_UPPER):
                add(*m.span("a"))
    for m in _hook.finditer(text):
        add(*m.span("a"))
    for m in _access_id.finditer(text):
        if not m.group().upper().endswith("EXAMPLE"):
            add(*m.span())
    for m in _header.finditer(text):
        value = m.group("a")
        if not _placeholder.search(value) and seg.residual(value) >= RESIDUAL_NAMED:
            add(*m.span("a"))
    for rx in (_named, _role):
        for m in rx.finditer(text):
            group = "a" if m.group("a") is not None else "b"
            key = re.sub(r"(?i)_role$", "", m.group("key"))
            if is_secret(key, m.group(group), True, True, seg):
                add(*m.span(group))
            elif m.group(group):
                taken.append(m.span(group))

    def pairs(at: int, end: int) -> None:
        while m := _pair.search(text, at, end):
            group = "a" if m.group("a") is not None else "b"
            a, b = m.span(group)
            value = text[a:b]
            if group == "b":
                # a key may stand inside an unquoted run such as //host/:_authToken=value
                at = a if "=" in value or ":" in value else b
                value = value.rstrip(".,:;)")
                b = a + len(value)
            else:
                at = b
            if free(a, b) and is_secret(m.group("key"), value, group == "a", plain, seg):
                add(a, b)
            elif group == "a":
                pairs(a, b)  # a literal of any length may itself hold pairs

    pairs(0, len(text))
    return sorted(spans)


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], re.sub(r"[^\r\n]", "*", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def found_secrets(chunks: DataFrame) -> DataFrame:
    """id, secret, redacted (the whole text with all its secrets replaced) of code chunks with secrets."""
    code = spread(chunks.where("content_type = 'code' and id is not null and text is not null").select("id", "language", "text"))
    counts = code.sparkSession.sparkContext.broadcast(word_counts(code))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(counts.value)
        for batch in text_slices(batches, 2):
            ids, secrets, texts = [], [], []
            for key, language, text in zip(*(c.to_pylist() for c in batch.columns)):
                spans = secrets_of(text, language, seg)
                if spans:
                    clean = redact(text, spans)
                    for s in dict.fromkeys(text[a:b] for a, b in spans):
                        ids.append(key)
                        secrets.append(s)
                        texts.append(clean)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, secrets, texts)], names=["id", "secret", "redacted"])

    return code.mapInArrow(run, "id string, secret string, redacted string")
