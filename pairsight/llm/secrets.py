"""Secret scans: base patterns, and strings that zstandard can't compress where a secret is likely.

A candidate is a run of key characters, of any length from 16 on, in a sensitive place: a word such as ``secret`` or
``auth`` is within reach before or after it, it lies in a private PEM block, or it adjoins a candidate in such a
place, as the lines of a key do. Its novelty is what it adds to the compressed size of the text around it, with a
dictionary of common identifiers as a primer: a word or an identifier is mostly found in dictionary or context, a
random string costs nearly its own entropy. A long run is measured in blocks that cover it. A run of letters of one
case can't cost much more than a new word does there, so what its pairs of letters cost against dictionary and
surroundings decides as well.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

KINDS = ("assign", "access", "hex", "novel")
#: What the base patterns match, and the length that a match must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
SENSITIVE = re.compile(r"secret|token|passw|pwd|credential|private|auth|bearer|signature|api.?key|access.?key|session", re.ASCII | re.IGNORECASE)
SENSITIVE_WORDS = ("secret", "token", "passw", "pwd", "credential", "private", "auth", "bearer", "signature", "api", "access", "session")
LEAST_RUN = 16
#: Characters before and after a candidate in which a sensitive word makes its context sensitive.
REACH = 60
#: What may stand between candidates that adjoin each other: quotes, joints and one line end.
_JOINT = r"""(?:[\x20\t"',;>#|*.+\\]|\\[nr]){0,80}"""
ADJOINING = re.compile(rf"{_JOINT}(?:\r?\n)?{_JOINT}")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY[A-Z ]{0,20}-----")
#: The short last line of a key.
TAIL = re.compile(rf"""{_JOINT}(?:\r?\n|\\n){_JOINT}([A-Za-z0-9+/_=-]{{1,15}})(?:(?<==)(?=["',;\x20\t]*(?:[\r\n]|\Z))|(?=["',;\s+\\nr]{{0,16}}-----END))""")
#: Characters of the blocks in which a longer run is measured, at most.
BLOCK = 200
#: Characters on either side of a candidate that it is compressed against.
AROUND = 800
#: Marginal bytes per character from which a candidate is novel. Identifiers stay well below; so do words that share syllables with the text around them.
NOVELTY = 0.8
#: The same for a candidate amid others of its kind, which pay for its alphabet: of 10,000 random base64 lines amid such lines the least had 0.672.
AMID = 0.65
#: Runs with the letters of one case only, the first may be a capital. Random ones cost less: bytes per character, and bits per letter from pairs of letters.
ONE_CASE = re.compile(r"[A-Z]?[a-z+/_=-]+|[A-Z+/_=-]+")
ONE_CASE_NOVELTY, ONE_CASE_BITS = 0.6, 4.8
#: Identifiers and words common around secrets in code and configuration.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key client_id client_secret private_key public_key "
    "authorization bearer credentials signature session_id username connection_string database_url hostname endpoint "
    "configuration environment production development staging default example placeholder changeme undefined null true "
    "false function return const static public private string integer import export class self this config settings "
    "getSecretValue setPassword accessToken refreshToken authenticate authorization_code grant_type redirect_uri"
)


def _compressor(made: dict = {}):  # noqa: B006  kept for the next call of the same task
    if not made:
        import zstandard

        primer = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made[0] = zstandard.ZstdCompressor(level=6, dict_data=primer, write_content_size=False, write_checksum=False)
    return made[0]


def novelty(around: str, candidate: str) -> float:
    """Marginal compressed bytes per character of a candidate against the text around it."""
    size = _compressor().compress
    around = around.encode(errors="replace")
    return (len(size(around + candidate.encode())) - len(size(around))) / len(candidate)


def letter_bits(around: str, candidate: str) -> float:
    """Bits per letter that a candidate's pairs of letters cost, after those of the identifiers and the text around it."""
    plain = lambda t: re.sub("[^a-z]+", " ", t.lower())
    known, own = plain(f"{IDENTIFIERS} {around}"), f" {plain(candidate).strip()} "
    pairs, firsts = Counter(zip(known, known[1:], strict=False)), Counter(known)
    cost = sum(-math.log2((pairs[a, b] + 0.5) / (firsts[a] + 13.5)) for a, b in zip(own, own[1:], strict=False) if b != " ")
    return cost / max(1, sum(c != " " for c in own))


def is_novel(text: str, start: int, end: int, least: float) -> bool:
    """Whether some block of a run is novel; blocks are of about the same length and cover the run."""
    n = -(-(end - start) // BLOCK)
    cuts = [start + (end - start) * i // n for i in range(n + 1)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        around, block = text[b : b + AROUND] + text[max(0, a - AROUND) : a], text[a:b]
        if ONE_CASE.fullmatch(block):
            if novelty(around, block) >= ONE_CASE_NOVELTY and letter_bits(around, block) >= ONE_CASE_BITS:
                return True
        elif novelty(around, block) >= (least if n == 1 else AMID):
            return True
    return False


def _private_blocks(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while (m := PEM.search(text, at)) and (end := text.find("-----END", m.end())) >= 0:
        out.append((m.end(), end))
        at = end
    return out


def uncovered(start: int, end: int, over: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What base spans, in order, leave of a run."""
    gaps = []
    for s, e, _ in over:
        if s > start:
            gaps.append((start, min(s, end)))
        start = max(start, e)
    return [*gaps, (start, end)] if start < end else gaps


def rest_of_run(text: str, start: int, end: int, over: list[tuple[int, int, str]], least: float) -> list[tuple[int, int]]:
    """What base spans leave of a run that they lie within and that belongs to a secret too: parts as long as a candidate that are novel, and shorter ones of a novel run whose letters aren't those of words.

    What stands before an assignment is its name, and a run by itself.
    """
    for cut in [s for s, _, kind in over if kind == "assign"]:
        end = min(end, max(start, cut))
    over = [x for x in over if x[0] < end]
    gaps = uncovered(start, end, over)
    around = text[end : end + AROUND] + text[max(0, start - AROUND) : start]
    # beside a key a part costs less, as letters of one case do; then its letters have to be no word's as well
    novel = lambda a, b: is_novel(text, a, b, least) or is_novel(text, a, b, ONE_CASE_NOVELTY) and letter_bits(around, text[a:b]) >= ONE_CASE_BITS
    out = [(a, b) for a, b in gaps if b - a >= LEAST_RUN and novel(a, b)]
    small = [(a, b) for a, b in gaps if b - a < LEAST_RUN and any(c.isalnum() for c in text[a:b])]
    if small and over and letter_bits(around, "".join(text[a:b] for a, b in small)) >= ONE_CASE_BITS and (out or is_novel(text, start, end, least)):
        out += small
    return sorted(out)


def _candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, list, bool]]:
    """start, end, the base spans that overlap, and whether it adjoins others, of all candidates in sensitive places."""
    blocks, at, block, runs = _private_blocks(text), 0, 0, []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][1] <= start:
            at += 1
        over, k = [], at
        while k < len(base) and base[k][0] < end:
            if base[k][1] > start:
                over.append(base[k])
            k += 1
        while block < len(blocks) and blocks[block][1] <= start:
            block += 1
        inside = block < len(blocks) and blocks[block][0] <= start
        near = inside or any(x[2] == "assign" for x in over) or bool(SENSITIVE.search(text, max(0, start - REACH), start) or SENSITIVE.search(text, end, end + REACH))
        joined = bool(runs) and ADJOINING.fullmatch(text, runs[-1][1], start) is not None
        runs.append([start, end, over, inside, near, joined])
    for i in range(1, len(runs)):
        runs[i][4] |= runs[i][5] and runs[i - 1][4]
    for i in range(len(runs) - 1, 0, -1):
        runs[i - 1][4] |= runs[i][5] and runs[i][4]
    after = [*(r[5] for r in runs[1:]), False][: len(runs)]
    return [(s, e, over, inside or joined or next_joined) for (s, e, over, inside, near, joined), next_joined in zip(runs, after, strict=True) if near]


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in a text, in code points, by start and then kind. Base kinds are whole; novel spans are runs that overlap none, and what base spans leave of a run that is novel."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(w in low for w in SENSITIVE_WORDS):
        for start, end, over, amid in _candidates(text, sorted(found)):
            least = AMID if amid else NOVELTY
            if over or is_novel(text, start, end, least):
                found += [(a, b, "novel") for a, b in (rest_of_run(text, start, end, over, least) if over else [(start, end)])]
                if amid and (tail := TAIL.match(text, end)):
                    found.append((*tail.span(1), "novel"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


SPANS = "array<struct<start:int,end:int,kind:string>>"


def scan_secrets(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """docs and a column with the spans of secrets as SPANS, in code points, end exclusive, in place of a column of that name.

    A null text is empty and has none. Texts may have any length; rows that repeat get the same.
    """

    bounded_batches(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(t)])

    return docs.withColumn(name, scan(F.coalesce(F.col(text), F.lit(""))))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every secret replaced by ``[kind]``; what overlaps is replaced together, under its first kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the secrets of a column replaced. Null stays null; texts may have any length; rows that repeat are treated alike, other columns stay as they are."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t, find_secrets(t)))

    return docs.withColumn(text, clean(F.col(text)))


def secret_digest(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    found = scan_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("secrets").alias("spans"), count("novel").alias("n_novel"))
