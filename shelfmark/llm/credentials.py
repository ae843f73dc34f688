"""Credentials in files of any kind, and their redaction (problem 3).

1. Every file is read for literals that could be credentials: values under a telling name, in
   a command or a call that takes a password, addresses with a password, and values of a known
   structure under any name; also in comments, base64-encoded or joined from pieces.
2. The literals are indexed corpus-wide. A value that many repositories share, in lines of their
   own, is a placeholder, whatever it looks like; so are the usual forms of placeholders.
3. All files are read again for the confirmed values, so a value is found wherever it stands. A
   bitmap of fixed size tells the places where a value may stand; their surroundings are joined
   with the values, which stay in a table, and read by an Aho-Corasick automaton of those at hand.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import cut

# Values whose structure tells by itself. Public formats of tokens.
TOKENS = (
    r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|gl(?:pat|dt|rt|ptt)-[\w-]{20,}|xox[abeoprs]-[\w-]{20,}"
    r"|[sr]k_live_[A-Za-z0-9]{16,}|AIza[\w-]{30,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{40,}|SG\.[\w-]{16,}\.[\w-]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}"
    r"|[a-z]{2,8}_[A-Za-z0-9]{28,44}"
)
TOKEN = re.compile(rf"(?<![A-Za-z0-9_/+=-])(?:{TOKENS})(?![A-Za-z0-9_=/+-])")
HOOK = re.compile(r"https?://[\w.-]*hooks?[\w.-]*/(?:services|workflows|api/webhooks|webhooks?)/[\w/-]{20,}|https?://[\w.-]+/(?:api/)?webhooks/\d+/[\w-]{20,}")
ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@\"'`<>]{1,}:([^\s@/\"'`<>]{4,})@[\w.-]+")
PASSWORD_PART = re.compile(r"(?i)(?:^|[;\s\"'])(?:password|pwd)\s*=\s*([^;\"'\s]{4,})(?=;|\"|'|$)")
BASIC = re.compile(r"(?i)\bBasic\s+([A-Za-z0-9+/]{8,}={0,2})")
BEARER = re.compile(r"(?i)\bBearer\s+([A-Za-z0-9._~+/-]{16,}=*)")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\\n|\\r|[\s\"'+,|>#*/-])*[A-Za-z0-9+/:]{16,}")
# Telling names.
NAMED = re.compile(
    r"""(?x) (?: (?<![Cc]om) [Pp](?:ass|ASS) | [Pp](?:wd|WD) | [Pp][Ww](?![A-Za-z]) | [Ss](?:ecret|ECRET) | [Tt](?:oken|OKEN) | [Kk](?:ey|EY)(?![a-z]) | [Cc](?:red|RED) (?=[es E S]) | [Aa](?:uth|UTH)(?![a-z]{2}) | [Bb](?:earer|EARER) )
        ([\w.\-]{0,40}) ["'`\]]* [ \t]* (?: (?:[a-z]+[ \t]+){0,6}? (?:[a-z]+(?=:))? (?: : [ \t]*(?:str|string|String)\b )? [ \t]* (?: => | := | =(?!=) | : | \bis\b | \bwas\b ) | (?<=[\w]) [ \t]+ (?=") )
        [ \t]* (?: (?:[\w.]*(?:decode|atob|unhex|fromhex|b64)\w*)\( [ \t]* )? (?: ["'`] ( [^"'`\n]{4,} ) ["'`] | ( [^\s"'`,;{}()\[\]<>=]{6,} (?![(\[]) ) )"""
)
PAIR = re.compile(r"""(?im)\bname["']?\s*[:=]\s*["']?([\w.-]+)["']?,?[ \t]*\n?[ \t]*["']?value["']?\s*[:=]\s*["']?([^\s"',}]{6,})""")
NAME_BEFORE = re.compile(r"[\w.\-]*\Z")
CALL = re.compile(r"""(?i)\b(?:connect|login|authenticate|auth|bind|sign_?in|log_?in|basic_?auth|set_?credentials?)\s*\(\s*["'`][^"'`\n]{1,}["'`]\s*,\s*["'`]([^"'`\n]{6,})["'`]""")
COMMAND = re.compile(r"""(?i)(?:--(?:password|passwd|pass|token|secret|api-key|auth-token)[ =]|\s-u\s+[^\s:'"]+:|sshpass\s+-p\s*)["']?([^\s"']{6,})["']?""")
CODED = re.compile(r"""(?i)\b[\w.]*(?:decode|atob|unhex|fromhex|b64)\w*\(\s*["'`]([A-Za-z0-9+/=_-]{8,})["'`]""")
CHAIN = re.compile(r"""(["'`])([^"'`\n]{2,})\1(?:\s*[+.]?\s*\\?\s*(["'`])([^"'`\n]{2,})\3)+""")
PIECE = re.compile(r"""(["'`])([^"'`\n]{2,})\1""")
JOINT = re.compile(r"""["'`][ \t]*\\?\n?[ \t]*\+[ \t]*\n?[ \t]*["'`]""")
ADJACENT = re.compile(r'"[ \t]*\n?[ \t]*"(?=[A-Za-z0-9])')

PARTS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
SURE = frozenset("password passwd passphrase pass pwd pw secret secrets token apikey credential credentials bearer passcode authtoken".split())
KEYED = frozenset("api access secret private auth billing maps hmac signing encryption account storage master service app client deploy shared session cookie license admin root webhook account stripe".split())
NOT_NAMES = frozenset("hint public verify authorized hash checksum digest fingerprint policy field label length count min max ttl expiry expires url uri path file dir type format prompt header class column index".split())
# What must stand in the lower-case text before a pattern is tried; "named" ones are tried right there.
NEEDLES = {
    "named": ("pass", "pwd", "pw", "secret", "token", "key", "cred", "auth", "bearer"),
    "address": ("://",), "part": ("password=", "pwd=", "password =", "pwd ="), "basic": ("basic ",), "bearer": ("bearer ",),
    "call": ("connect(", "login(", "log_in(", "authenticate(", "auth(", "bind(", "signin(", "sign_in(", "credentials(", "credential(", "connect ("),
    "command": ("--pass", "--token", "--secret", "--api-key", "--auth-token", " -u ", "sshpass"),
    "coded": ("decode", "atob", "unhex", "fromhex", "b64"), "pair": ("value",),
}
_MACHINE: list = []


def machine():
    """The automaton over all needles, made once in each process."""
    if not _MACHINE:
        import ahocorasick

        m = ahocorasick.Automaton()
        kinds: dict[str, list[str]] = {}
        for kind, words in NEEDLES.items():
            for w in words:
                kinds.setdefault(w, []).append(kind)
        for w, k in kinds.items():
            m.add_word(w, (tuple(k), len(w)))
        m.make_automaton()
        _MACHINE.append(m)
    return _MACHINE[0]


PLACE = re.compile(
    r"(?i)^(?:[x*.\-_#?0•]+|<.*|.*>|\$.*|%.*%|\{\{.*|.*\}\}|#\{.*|@.*@|.*\$\{.*|.*\{\{.*|\[.*\]?|(?:my|your|the|some|any|insert|put|enter|add|set|use|fill|type|paste)[-_ ].*|your.*|.*(?:example|sample|placeholder|dummy|change[-_ ]?(?:me|it|this)|replace[-_ ]?(?:me|this|with)|not[-_ ]?(?:a[-_ ])?real|redacted|hidden|masked|removed|fixme|goes[-_ ]here|[-_]here$|fake|foobar|lorem|todo|tbd|xxxx).*"
    r"|(?:none|null|nil|undefined|true|false|on|off|yes|no|test|testing|default|empty|unset|missing|string|str|value|secret|password|passwd|token|key|user|username|admin|root|guest)\d{0,3}|n/a|(?:env|os|process|vault|config|settings|secrets?|getenv|ssm|kms|arn|op|file|gcp|aws|azure)[.:/(].*|env\[.*)$"
)
VERSION = re.compile(r"^[vV]?\d+(?:[.\-:/]\d+)*$")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
CHECKSUM = re.compile(r"(?i)^(?:sha\d+|md5|blake\w*)[-:]|^ssh-|^ecdsa-")


def telling(name: str) -> bool:
    """Whether a name says that its value is a credential."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts or NOT_NAMES.intersection(parts) or parts[-1] == "id":
        return False
    if SURE.intersection(parts):
        return True
    return any(p == "key" and k and parts[k - 1] in KEYED for k, p in enumerate(parts)) or parts[-1] == "auth"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def usable(value: str) -> bool:
    """A literal that could be used as it stands."""
    v = value.strip()
    if len(v) < 6 or PLACE.match(v) or VERSION.match(v) or UUID.match(v) or CHECKSUM.match(v) or any(c.isspace() for c in v):
        return False
    if len(set(v)) < 5 or not v.isprintable():
        return False
    digit, lower, upper = any(c.isdigit() for c in v), any(c.islower() for c in v), any(c.isupper() for c in v)
    special = any(not c.isalnum() and c not in "-_./" for c in v)
    if not (digit and (lower or upper)) and not (lower and upper and special):
        return len(v) >= 12 and lower and upper and entropy(v) >= 3.2 and sum(a.islower() != b.islower() for a, b in zip(v, v[1:])) >= 0.35 * len(v)
    if re.match(r"^[a-z]+(?:[_-][a-z]+)*\d?$", v) and len(v) < 12 and not re.search(r"\d{2,}$", v):
        return False
    return entropy(v) >= 2.3


def decoded(value: str) -> str | None:
    """The printable text, line ends included, that a base64 or hexadecimal literal stands for."""
    for f in (lambda: base64.b64decode(value + "=" * (-len(value) % 4), validate=True), lambda: bytes.fromhex(value)):
        try:
            t = f().decode("ascii")
        except (binascii.Error, ValueError):
            continue
        if len(t) >= 6 and all(c.isprintable() or c in "\t\r\n" for c in t):
            return t
    return None


def structured(value: str) -> bool:
    m = TOKEN.fullmatch(value)
    if m:
        body = value.split("_", 1)[-1]
        if re.match(r"[a-z]{2,8}_", value) and not value.startswith(("ghp_", "gho_", "ghs_", "ghu_", "ghr_", "npm_", "github_pat_", "sk_", "rk_")):
            return any(c.isdigit() for c in body) and any(c.isupper() for c in body) and any(c.islower() for c in body) and entropy(body) >= 3.6
        return entropy(value) >= 2.8 and not PLACE.match(value)
    if HOOK.fullmatch(value):
        return entropy(value.rsplit("/", 1)[-1]) >= 3 and not re.search(r"(?i)x{4}|your|example", value)
    return False


def literals(text: str) -> list[tuple[int, str, bool]]:
    """(offset, value, structured) of possible credentials; the value as it stands in the text."""
    out: dict[int, tuple[str, bool]] = {}

    def add(at: int, value: str, sure: bool):
        v = value.rstrip(",;:)") if not sure and len(value) > 9 else value
        if at not in out or sure and not out[at][1]:
            out[at] = (v, sure)

    low = text.lower()
    kinds: set[str] = set()
    named: list[int] = []
    for end, (found, n) in machine().iter(low):
        if found[0] == "named":
            named.append(end - n + 1)
        kinds.update(found)
    if len(low) != len(text):  # lower-casing moved places
        named = [m.start() for m in NAMED.finditer(text)]
    for m in TOKEN.finditer(text):
        if structured(m.group()):
            add(m.start(), m.group(), True)
    for m in HOOK.finditer(text):
        if structured(m.group()):
            add(m.start(), m.group(), True)
    for m in PRIVATE.finditer(text):
        add(m.start(), "-----" + m.group().split("-----")[1] + "-----", True)
    if "address" in kinds:
        for m in ADDRESS.finditer(text):
            if not PLACE.match(m.group(1)):
                add(m.start(), m.group(), True)
    if "part" in kinds and ";" in text:
        for m in PASSWORD_PART.finditer(text):
            if ";" in text[max(0, m.start() - 80) : m.end() + 2] and not PLACE.match(m.group(1)) and re.search(r"(?i)server|host|data source|user id|uid|database", text[max(0, m.start() - 120) : m.end() + 80]):
                add(m.start(1), m.group(1), True)
    if "basic" in kinds:
        for m in BASIC.finditer(text):
            t = decoded(m.group(1))
            if t and ":" in t and not PLACE.match(t.split(":", 1)[1]):
                add(m.start(1), m.group(1), True)
    for kind, rx in (("bearer", BEARER), ("call", CALL), ("command", COMMAND)):
        if kind in kinds:
            for m in rx.finditer(text):
                if usable(m.group(1)):
                    add(m.start(1), m.group(1), False)
    if "coded" in kinds:
        for m in CODED.finditer(text):
            t = decoded(m.group(1))
            if t and (structured(t) or PRIVATE.search(t) or ADDRESS.match(t) and not PLACE.match(ADDRESS.match(t).group(1))):
                add(m.start(1), m.group(1), True)
    for at in named:
        m = NAMED.match(text, at)
        if not m:
            continue
        before = NAME_BEFORE.search(text[max(0, at - 60) : at]).group()
        if not telling(before + text[at : m.start(1)] + m.group(1)):
            continue
        value, start = (m.group(2), m.start(2)) if m.group(2) else (m.group(3), m.start(3))
        if CODED.search(text[m.start() : m.end() + 1]):
            t = decoded(value)
            if t and not PLACE.match(t) and (usable(t) or structured(t) or PRIVATE.search(t)):
                add(start, value, False)
        elif usable(value):
            add(start, value, structured(value))
    for m in PAIR.finditer(text) if "pair" in kinds else ():
        if telling(m.group(1)) and usable(m.group(2)):
            add(m.start(2), m.group(2), structured(m.group(2)))
    if JOINT.search(text) or ADJACENT.search(text):
        for m in CHAIN.finditer(text):
            pieces = [p.group(2) for p in PIECE.finditer(m.group())]
            whole = "".join(pieces)
            line_start = text.rfind("\n", 0, m.start()) + 1
            names = [x for x in re.findall(r"[A-Za-z_][\w.-]*", text[line_start : m.start()])]
            sure = structured(whole) or bool(ADDRESS.fullmatch(whole) or ADDRESS.match(whole)) and not PLACE.match((ADDRESS.match(whole) or [None, "x"])[1])
            conn = PASSWORD_PART.search(whole)
            if sure or (conn and ";" in whole and not PLACE.match(conn.group(1))) or (any(telling(x) for x in names[-2:]) and usable(whole)):
                for a in range(m.start(), m.end()):
                    out.pop(a, None)
                add(m.start(2), m.group()[1:-1], True)
    return [(a, *v) for a, v in out.items()]


INDEX = "file_id long, repo_id string, line_no int, at int, value string, structured boolean, line long"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, repo, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for at, value, sure in literals(text):
                end = text.find("\n", at)
                line = text[text.rfind("\n", 0, at) + 1 : end if end >= 0 else len(text)].strip()
                rows.append((i, repo, text.count("\n", 0, at) + 1, at, value, sure, xxhash.xxh3_64_intdigest(line) >> 1))
        cols = list(zip(*rows)) or [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file_id", "repo_id", "line_no", "at", "value", "structured", "line"])


# Anchors: a window of bytes of each value; short values have short ones.
WIDE, NARROW = 8, 4
BITS = 26
MIX = np.uint64(0x9E3779B97F4A7C15)
TELLING = bytes(1 if chr(c).isdigit() or chr(c).isupper() else 0 for c in range(128)) + bytes(128)


def anchor(value: str) -> tuple[int, int, int]:
    """(width, offset in characters, key) of a value's anchor: its window with the most digits and capitals."""
    b = value.encode()
    width = WIDE if len(b) >= WIDE else NARROW
    marks = b.translate(TELLING)
    best = max((k for k in range(len(b) - width + 1) if b[k] & 0xC0 != 0x80), key=lambda k: sum(marks[k : k + width]), default=0)
    key = int.from_bytes(b[best : best + width].ljust(WIDE, b"\0"), "little", signed=True)
    return width, len(b[:best].decode()), key


def bit_of(keys: np.ndarray) -> np.ndarray:
    """Places of keys in a bitmap of 2 ** BITS bits."""
    return (keys * MIX) >> np.uint64(64 - BITS)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_pylist()
        found = [anchor(v) for v in values]
        keys = np.array([k for _, _, k in found], dtype=np.int64)
        bits = bit_of(keys.view(np.uint64)).astype(np.int64)
        cols = [pa.array(values, pa.string()), pa.array([w for w, _, _ in found], pa.int32()), pa.array([o for _, o, _ in found], pa.int32()), pa.array(keys), pa.array(bits)]
        yield pa.RecordBatch.from_arrays(cols, names=["value", "width", "offset", "key", "bit"])


def hits(raw: bytes, bitmaps: dict[int, np.ndarray], chunk: int = 1 << 20) -> Iterator[tuple[int, int, int]]:
    """(width, key, place) of the windows of some bytes that a bitmap holds, a bounded part at a time."""
    for start in range(0, len(raw), chunk):
        data = np.frombuffer(raw[start : start + chunk + WIDE - 1] + b"\0" * (2 * WIDE - 1), dtype=np.uint8)
        keys = np.empty(len(data) // 8 * 8, dtype=np.uint64)
        for k in range(8):
            part = data[k : k + (len(data) - k) // 8 * 8].view(np.uint64)
            keys[k::8][: len(part)] = part[: len(keys[k::8])]
        keys = keys[: min(chunk, len(raw) - start)]
        for width, bitmap in bitmaps.items():
            x = keys if width == WIDE else keys & np.uint64(0xFFFFFFFF)
            bit = bit_of(x)
            for h in np.flatnonzero((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).tolist():
                if raw[start + h] & 0xC0 != 0x80:
                    yield width, int(x[h].view(np.int64)), start + h


def _rescan(maps, longest: int):
    """Pieces of texts around each place whose bytes are an anchor, by the bitmaps.

    A piece reaches ``longest`` characters to both sides, so that it holds every value whose
    anchor stands there, and one more, by which its ends are judged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = maps.value
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                for width, key, h in hits(raw, bitmaps):
                    at = h if len(raw) == len(text) else len(raw[:h].decode())
                    a, b = max(0, at - longest), min(len(text), at + longest)
                    # one character more to both sides, none where the text ends
                    rows.append((i, width, key, at - a, a, text.count("\n", 0, a), text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]))
            cols = list(zip(*rows)) or [[]] * 9
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file_id", "width", "key", "inside", "start", "lines", "piece", "left", "right"])

    return run


PIECES = "file_id long, width int, key long, inside int, start int, lines int, piece string, left string, right string"
PLACES = "file_id long, line_no int, at int, until int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of values in their pieces: an automaton of the values that meet a batch of pieces."""
    import ahocorasick

    for batch in batches:
        ids, starts, lines, pieces, lefts, rights, values = (batch.column(k).to_pylist() for k in range(7))
        known = ahocorasick.Automaton()
        for v in set(values):
            known.add_word(v, v)
        if values:
            known.make_automaton()
        rows, found = [], {}
        for i, start, before, piece, left, right, value in zip(ids, starts, lines, pieces, lefts, rights, values):
            if (i, start) not in found:
                found = {(i, start): [(end, v) for end, v in known.iter(piece)]}
            for end, v in found[i, start]:
                if v != value:
                    continue
                a, b = end - len(v) + 1, end + 1
                first, after = piece[a - 1] if a else left, piece[b] if b < len(piece) else right
                if not (first.isalnum() and piece[a].isalnum() or after.isalnum() and piece[b - 1].isalnum()):
                    rows.append((i, before + piece.count("\n", 0, a) + 1, start + a, start + b))
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.int32()])], names=["file_id", "line_no", "at", "until"])


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "REDACTED") -> str:
    """``text`` with the spans replaced by ``mark``; all else, line ends too, stays as it is."""
    out, last = [], 0
    for a, b in sorted(spans):
        if b <= last:
            continue
        a = max(a, last)
        out += [text[last:a], re.sub(r"[^\n\r\"'`+\\, \t]+", mark, text[a:b], count=1) if "\n" in text[a:b] or '"' in text[a:b] or "'" in text[a:b] else mark]
        if "\n" in text[a:b] or '"' in text[a:b] or "'" in text[a:b]:
            # further pieces of a joined value go, their quotes and line ends stay
            head = out.pop()
            cut_at = head.find(mark) + len(mark)
            out.append(head[:cut_at] + re.sub(r"[A-Za-z0-9_=/!@#$%^&*.:;-]+", "", head[cut_at:]))
        last = b
    return "".join([*out, text[last:]])


class Credentials:
    """Credentials in files (file_id, repo_id, content); other columns are ignored.

    Null or blank contents give nothing. A null repo_id counts as an owner of its own. Copies of
    a file are each reported. A value is widely shared if it stands in different lines of many
    repositories, which copies of one file never make: in more than ``shared`` of all (and
    ``few`` at least). Such a value is a placeholder, whatever its structure.
    """

    def __init__(self, files: DataFrame, shared: float = 0.02, few: int = 25):
        self.files = files.select("file_id", F.coalesce("repo_id", F.lit("")).alias("repo_id"), "content").where(F.col("content").rlike(r"\S"))
        self.index = cut(self.files.mapInArrow(_index, INDEX))
        repos = self.files.select("repo_id").distinct().count()
        owners = self.index.groupBy("value").agg(F.countDistinct("repo_id").alias("repos"), F.countDistinct("line").alias("lines"), F.max("structured").alias("structured"))
        own = ~F.col("value").startswith("-----BEGIN")
        self.confirmed = cut(owners.where(~own | (F.least("repos", "lines") <= max(few, shared * repos))))

    def occurrences(self) -> DataFrame:
        """(file_id, line_no, at, until): every place of every confirmed value.

        Private keys come from the index, up to their END line. Other values are searched in all
        files by one more reading, whatever their number: a bitmap of anchors, of a fixed size,
        picks the places, whose surroundings are joined with the values and read by automata.
        """
        found = self.index.join(self.confirmed.select("value"), "value", "left_semi").select("file_id", "line_no", "at", (F.col("at") + F.length("value")).cast("int").alias("until"))
        values = self.confirmed.where(~F.col("value").startswith("-----BEGIN")).select("value")
        keys = cut(values.mapInArrow(_anchors, "value string, width int, offset int, key long, bit long"))
        buckets = keys.groupBy("width", F.shiftright("bit", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("map")).collect()
        if not buckets:
            return found.distinct()
        longest = keys.agg(F.max(F.length("value"))).first()[0]
        bitmaps: dict[int, np.ndarray] = {}
        for r in buckets:
            bitmaps.setdefault(r["width"], np.zeros(1 << BITS - 3, dtype=np.uint8))[r["bucket"] << 12 : (r["bucket"] + 1) << 12] = np.frombuffer(r["map"], dtype=np.uint8)
        pieces = self.files.select("file_id", "content").mapInArrow(_rescan(self.files.sparkSession.sparkContext.broadcast(bitmaps), longest), PIECES)
        meet = pieces.join(keys.drop("bit"), ["width", "key"]).where(F.substring("piece", F.col("inside") - F.col("offset") + 1, F.length("value")) == F.col("value"))
        again = meet.select("file_id", "start", "lines", "piece", "left", "right", "value").mapInArrow(_verify, PLACES)
        return found.union(again).distinct()

    def lines(self) -> DataFrame:
        return self.occurrences().select("file_id", F.col("line_no").cast("long").alias("line_no")).distinct()

    def redact(self) -> DataFrame:
        """(file_id, content): contents of files with credentials, these replaced."""
        spans = self.occurrences().groupBy("file_id").agg(F.collect_set(F.struct("at", "until")).alias("spans"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts, spans_ = (batch.column(k).to_pylist() for k in range(3))
                out = []
                for t, s in zip(texts, spans_):
                    wide = []
                    for x in s:
                        a, b = x["at"], x["until"]
                        if t[a : a + 10] == "-----BEGIN":
                            e = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----").search(t, a)
                            body = t[b : e.start()] if e else t[b:]
                            wide += [(b + m.start(), b + m.end()) for m in re.finditer(r"(?<!\\)[A-Za-z0-9+/=:]{8,}", body)]
                        else:
                            wide.append((a, b))
                    out.append(redacted(t, wide))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["file_id", "content"])

        return self.files.join(spans, "file_id").select("file_id", "content", "spans").mapInArrow(run, "file_id long, content string")
