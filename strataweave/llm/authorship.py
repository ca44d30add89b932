"""Generated, minified or vendored source files, and bulk data kept as code.

Five linear support-vector machines score every file, on hashed character n-grams of each line of its comments and of each
of its lines (how notices read), on those of the whole text with the giveaway lines masked (how such code looks: one machine
for all labels, one for minified and bulk data), and on hashed path components.  A file's score is the greatest distance above their thresholds.  They are trained on a bounded hash
sample of the files (`SAMPLE`) whose labels come from what files say about themselves: notices in comments, places that
tools own, the measured shape.  Half of the repositories trains, a quarter sets the thresholds (for at least
`PRECISION` on their labels), a quarter reports.

An exact check follows where a machine is in doubt: scores below 0 but not below its `doubt`, the least score that keeps
`RECALL` of its labels of that quarter (less `SLACK`).  Such a file is taken if the notice, the place or the shape that the
machine in doubt stands for confirms it.  From 0 on a file is taken, and where no machine is in doubt it is not, whatever the
check would say.

Defined cases: null and blank content is no case; a null path counts as empty; repeated rows of a file_id count once
(latest scanned_at); an empty table, or a sample with one kind of label only, trains nothing: then the exact check decides
alone; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import project_key
from strataweave.llm.syntax import language

#: Files that the classifiers are trained, validated and reported on, at most about.
SAMPLE = 4000
#: Paths on which places are learnt, at most about.
PATHS = 30_000
#: Lines that one sampled file gives to training at most, and characters of each.
LINES, LINE = 24, 400
#: Least precision of the thresholds, and recall of `doubt`, on the repositories that set them.
PRECISION, RECALL = 0.999, 0.998
#: Labels of a kind without which nothing is below doubt.
FEW = 20
#: How far above the least precise score a threshold lies, and how much further down files are in doubt (support vectors lie at -1 and 1).
MARGIN, SLACK = 0.25, 0.5
#: The owner of the repositories; its own notices mark no foreign file.
OWNER = "harborline"
TEXT_DIMS, PATH_DIMS, LINE_DIMS, GRAM = 4096, 2**14, 2**16, 5
PATH_SCALE = 0.5
#: Least score that is precise: no threshold lies below it.
LEAST = 0.25

# Folders and file names that tools own.
_OWNED_DIRS = {"node_modules", "bower_components", "vendor", "vendored", "third_party", "thirdparty", "third-party", "extern", "contrib", "obj", "dist", "generated", "__generated__"}
_OWNED_PAIRS = {("libs", "external"), ("wwwroot", "lib"), ("target", "debug"), ("target", "release")}
_OWNED_NAME = re.compile(r"(?i)\.min\.|\.bundle\.|\.generated\.|\.gen\.|\.g\.(i\.)?cs$|\.designer\.cs$|_pb2?(_grpc)?\.|_grpc_pb\.|\.pb\.|^(package-lock|npm-shrinkwrap|packages\.lock|composer\.lock|deno\.lock)\.json$|\.lock\.json$|\.deps\.json$")
# What tools and licences write into files.
_TOOL = re.compile(
    r"(?im)<auto-?generated|@generated\b|\bcode generated (by|from)\b|\bauto(matically)?[- ]?generated (file|code|by|from|with)\b|\bmachine[- ]generated\b"
    r"|\bth(is|e) (code|file|class|module|source) (is|was|has been) (auto(matically)?[- ]?)?(generated|produced|created|emitted|written) (by|from|with)\b"
    r"|\b(generated|produced|created|emitted|compiled) (by|from|with|using)\b.{0,80}\b(do not|don't|never) (edit|modify|change|touch)\b"
    r"|\bdo not (modify|edit|change|touch)( this file)?( by hand| manually|[\W]*$)|\b(manual |hand )?(edits|changes) (here )?(are|will be|get) (overwritten|lost|discarded)\b|\bregenerate (this file )?(with|by|using)\b"
    r"|\bautomatisch (erzeugt|generiert|erstellt)\b|\bnicht (manuell |von hand )?(bearbeiten|ändern|editieren)\W*$|\bgenerad[oa] (automáticamente|automaticamente|por|con)\b.{0,60}$|\bno (editar|modificar)\b"
    r"|\bgénérée? (automatiquement|par)\b|\bne pas (modifier|éditer)\b|\bgerad[oa] automaticamente\b|\bnão (editar|edite|modificar)\b|\bgenerato automaticamente\b|\bnon modificare\b"
)
_LICENCE = re.compile(
    r"(?i)@licen[cs]e\b|SPDX-License-Identifier|\breleased under the\b|\bredistribution and use in source\b|\blicensed under the\b|\bpermission is hereby granted\b|\bBSD \d-Clause\b|\bMIT licen[cs]e\b|\bapache license\b"
    r"|(copyright|\(c\)) .*\b(contributors|authors|project|foundation)\b|\bthis file is part of \S+ v?\d"
)
_FOREIGN_CODE = re.compile(
    r"""__(license|author|version)__\s*=\s*['"].*\n?.*__(license|author|version)__\s*=|\bVERSION\s*=\s*['"][a-z][\w-]*/\d+\.\d+|\bVERSION:\s*['"][\d.]+['"],\s*homepage:\s*['"]https?:"""
    r"""|\bUPSTREAM\b[^=\n]*=\s*"https?:|\bVersion\s*=\s*"\w+ \d+\.\d+[\d.]*";[^\n]*\bHome\s*=\s*"https?:|\[[\w.]*GeneratedCode(Attribute)?\s*\("""
)
_DATA_LINE = re.compile(r"""\s*[\[{(]*(?:\s*(?:-?\d[\w.]*|0x\w+|[bBrRuU]?'[^'\n]*'|[bBrRuU@]?"[^"\n]*"|null|["']?\w+["']?\s*:\s*(?:-?\d[\d.]*|"[^"\n]*"|'[^'\n]*'))\s*[+,)}\]]*)+[);]*\s*""")


def extension(path: str) -> str:
    return path.rpartition(".")[2].lower().strip()


def path_parts(path: str) -> tuple[list[str], str]:
    *dirs, name = path.replace("\\", "/").strip().split("/")
    return dirs, name


def owned_place(path: str) -> bool:
    dirs, name = path_parts(path)
    low = [d.lower() for d in dirs]
    # A capitalised folder of a module (Vendors, External, Packages) is a name of the domain, not a place of a tool.
    return any(d in _OWNED_DIRS for d in low) or any(p in _OWNED_PAIRS for p in zip(low, low[1:])) or bool(_OWNED_NAME.search(name))


def comment_blocks(path: str, text: str) -> Iterator[str]:
    """Comments outside strings; those with nothing but white space between them are one."""
    ext, block = extension(path), []
    lang = language(ext) if ext in ("cs", "ts", "js", "py", "sql", "rs") else None
    for t in lang.lexer.findall(text.replace("\r\n", "\n")) if lang else ():
        if t[:2] in ("//", "/*", "--") or t[0] == "#" and lang.kind in ("py", "cs"):
            block.append(t)
        elif t[0] != "\n" and block:
            yield "\n".join(block)
            block = []
    if block:
        yield "\n".join(block)


def code_notice(text: str) -> re.Match | None:
    m = _FOREIGN_CODE.search(text)
    return m if m and ("GeneratedCode" not in m.group() or text.count('"', 0, m.start()) % 2 == 0) else None


def notices(path: str, text: str, owner: str = OWNER) -> bool:
    """Whether a comment or a statement outside strings says that the file is a tool's or another party's."""
    return any(_TOOL.search(c) or _LICENCE.search(c) and owner not in c.lower() for c in comment_blocks(path, text)) or code_notice(text) is not None


def shape(text: str) -> bool:
    """Minified or bulk data: nearly all characters in very long lines or in lines of literals."""
    lines = [x for x in text.splitlines() if x.strip()]
    total = sum(map(len, lines)) or 1
    # Prose and queries kept in one long string have a space every few characters; packed code and data do not.
    if sum(len(x) for x in lines if len(x) > 200 and x.count(" ") < 0.12 * len(x)) >= 0.8 * total:
        return True
    if len(lines) <= 15 or total <= 1500 or text.count("(") + text.count("=") - sum(x.lstrip().startswith("(") for x in lines) > 0.015 * total:
        return False  # calls and assignments, but for rows in brackets: code
    return sum(len(x) for x in lines if len(x) < 400 and len(x) > 12 and _DATA_LINE.fullmatch(x)) >= 0.85 * total


#: The exact checks, by what they look at.
CHECKS = {"place": lambda path, text, owner: owned_place(path), "shape": lambda path, text, owner: shape(text), "notice": notices}


def confirmed(path: str, text: str, owner: str = OWNER) -> bool:
    return any(check(path, text, owner) for check in CHECKS.values())


# Comments as the group, strings so that nothing in them is taken for a comment.
_C_COMMENTS = r"(//[^\n]*|/\*[\s\S]*?\*/)"
_COMMENTS = {
    "cs": re.compile(rf'{_C_COMMENTS}|"""[\s\S]*?"""|@"(?:[^"]|"")*"|"(?:[^"\\\n]|\\.)*"'),
    "rs": re.compile(rf'{_C_COMMENTS}|r#+"[\s\S]*?"#+|"(?:[^"\\]|\\[\s\S])*"'),
    "ts": re.compile(rf"{_C_COMMENTS}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`"),
    "py": re.compile(r"(#[^\n]*)|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"),
    "sql": re.compile(r"(--[^\n]*|/\*[\s\S]*?\*/)|'(?:[^']|'')*'"),
}
_COMMENTS["js"] = _COMMENTS["ts"]
#: The owner's name in a comment stands for this many comments before and after it too.
NEAR = 4
_PLAIN = bytes(48 if 48 <= c < 58 else c + 32 if 65 <= c < 91 else 32 if c in (9, 13) else c for c in range(256))  # lower case, digits alike


def plain_lines(text: str) -> list[bytes]:
    return [x.strip() for x in text.encode("utf-8", "replace").translate(_PLAIN).split(b"\n")]


def comment_lines(path: str, text: str, owner: str) -> tuple[list[bytes], np.ndarray]:
    """The lines of all comments outside strings, and for each whether the owner is named in or near it."""
    pattern = _COMMENTS.get(extension(path))
    comments = [c for c in pattern.findall(text) if c] if pattern else []
    split = [plain_lines(c) for c in comments]
    own = np.zeros(sum(map(len, split)), dtype=np.float32)
    if owner in text.lower():
        starts = np.cumsum([0, *map(len, split)])
        for k, c in enumerate(comments):
            if owner in c.lower():
                own[starts[max(0, k - NEAR)] : starts[min(len(split), k + NEAR + 1)]] = 1
    return [x for ls in split for x in ls], own


def hashed(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = max(0, len(raw) - GRAM + 1)
    h = np.zeros(n, dtype=np.uint32)
    for k in range(GRAM if n else 0):
        h *= np.uint32(16777619)
        h += raw[k : n + k]
    h ^= h >> np.uint32(15)
    return h


def line_grams(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all lines one after another, and how many each line has; a short line is padded."""
    padded = [x if len(x) >= GRAM else x.ljust(GRAM) for x in lines]
    h = hashed(np.frombuffer(b"\n".join(padded), dtype=np.uint8))
    sizes = np.array([len(x) - GRAM + 1 for x in padded], dtype=np.int64)
    keep = np.ones(len(h), dtype=bool)
    over = np.cumsum(sizes + GRAM)[:-1] - GRAM  # from here on grams reach over a line's end
    for k in range(GRAM):
        keep[over + k] = False
    return (h[keep] % LINE_DIMS).astype(np.int64), sizes


def text_vector(text: str) -> np.ndarray:
    """Unit vector of hashed character n-grams of the whole text; zero for less than one."""
    h = hashed(np.frombuffer(text.strip().encode("utf-8", "replace"), dtype=np.uint8))
    counts = np.log1p(np.bincount(h % TEXT_DIMS, minlength=TEXT_DIMS)).astype(np.float32)
    return counts / (np.linalg.norm(counts) or 1)


def path_features(path: str) -> list[int]:
    """Hashed components: folders, pairs of folders, the name, its endings and parts, capitals of folders."""
    dirs, name = path_parts(path)
    low, words = [d.lower() for d in dirs], re.split(r"[._-]+", name.lower())
    parts = {f"d:{d}" for d in low} | {f"p:{a}/{b}" for a, b in zip(low, low[1:])} | {f"w:{w}" for w in words[1:]} | {f"e:{'.'.join(words[k:])}" for k in range(len(words))} | {f"c:{d[:1].isupper()}:{d.lower()}" for d in dirs}
    return sorted({zlib.crc32(p.encode("utf-8", "replace")) % PATH_DIMS for p in parts})


@dataclass
class Machine:
    weights: np.ndarray
    bias: float
    threshold: float = 0.0

    def lines(self, lines: list[bytes], own: np.ndarray | float = 0.0) -> np.ndarray:
        h, sizes = line_grams(lines)
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(self.weights[h], starts) / np.sqrt(sizes) + own * self.weights[LINE_DIMS] + (self.bias - self.threshold)


@dataclass
class Model:
    comment: Machine
    code: Machine
    text: Machine
    form: Machine
    path: Machine
    doubts: dict[str, float]  # by what the machines stand for: notice, shape, place
    owner: str
    report: dict

    def of_path(self, path: str) -> float:
        return float(self.path.weights[path_features(path)].sum() * PATH_SCALE + (self.path.bias - self.path.threshold))

    def scores(self, path: str, text: str) -> tuple[float, ...]:
        """Distance above the threshold of each machine."""
        comments, own = comment_lines(path, text, self.owner)
        vector = text_vector(text)
        return (
            float(self.comment.lines(comments, own).max()) if comments else -1.0,
            float(self.code.lines(plain_lines(text)).max()),
            *(float(vector @ m.weights + (m.bias - m.threshold)) for m in (self.text, self.form)),
            self.of_path(path),
        )

    def score(self, path: str, text: str) -> float:
        return max(self.scores(path, text))

    def verdict(self, path: str, text: str) -> tuple[float, bool | None]:
        """The greatest score, and what the exact check says (null where no machine is in doubt)."""
        comment, code, like, shaped, place = self.scores(path, text)
        best = max(comment, code, like, shaped, place)
        if best >= 0:
            return best, None
        checks = [c for c, s in (("place", place), ("shape", shaped), ("notice", max(comment, code))) if s >= self.doubts[c]]
        return best, any(CHECKS[c](path, text, self.owner) for c in checks) if checks else None


def descend(score: Callable, gradient: Callable, y: np.ndarray, dims: int, bound: float, c: float, rounds: int) -> Machine:
    """Squared-hinge support-vector machine by accelerated gradient descent; both kinds of label weigh the same.

    score(w): the rows times w; gradient(slack): slack times the rows; bound: the greatest square of a row's length."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(dims, dtype=np.float32), 0.0
    vw, vb, wp, bp = w, b, w, b
    step = 1.0 / (2 * c * (bound + 1) + 1)
    for t in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (score(vw) + vb)) * weight * y
        wn = vw + step * (2 * c * gradient(slack) - vw)
        bn = vb + step * 2 * c * float(slack.sum())
        m = (t - 1) / (t + 2)
        vw, vb, wp, bp = wn + m * (wn - wp), bn + m * (bn - bp), wn, bn
    return Machine(wp.astype(np.float32), bp)


def train_dense(x: np.ndarray, y: np.ndarray, c: float = 300.0, rounds: int = 300) -> Machine:
    """The rows are unit vectors."""
    return descend(lambda w: x @ w, lambda s: s @ x, y, x.shape[1], 1.0, c, rounds)


def train_sparse(at: np.ndarray, sizes: np.ndarray, scale: np.ndarray, dims: int, bound: float, y: np.ndarray, c: float = 300.0, rounds: int = 200) -> Machine:
    """Rows one after another: the features of each (`sizes` of them in `at`, at least one), all worth the row's `scale`."""
    starts = np.cumsum(sizes) - sizes

    def gradient(slack: np.ndarray) -> np.ndarray:
        live = np.nonzero(slack)[0]
        n = sizes[live]
        which = np.repeat(starts[live] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(at[which], weights=np.repeat((slack * scale)[live], n), minlength=dims).astype(np.float32)

    return descend(lambda w: np.add.reduceat(w[at], starts) * scale, gradient, y, dims, bound, c, rounds)


def train_lines(rows: list[tuple[bytes, float]], y: np.ndarray) -> Machine:
    """rows: (line, whether the owner is named)."""
    h, sizes = line_grams([x for x, _ in rows])
    scale = (1 / np.sqrt(sizes)).astype(np.float32)
    own = np.array([o for _, o in rows]) > 0
    # The owner's flag is one more feature, as often as makes it worth 1 whatever the line's length.
    ends = np.cumsum(sizes)
    times = np.where(own, np.round(np.sqrt(sizes)), 0).astype(np.int64)
    at = np.insert(h, np.repeat(ends, times), LINE_DIMS)
    return train_sparse(at, sizes + times, scale, LINE_DIMS + 1, 2.0, y)


def train_paths(rows: list[tuple[str, str]]) -> Machine:
    """rows: (project, path).  Components that only one repository has tell nothing of others and stay out."""
    of: dict[int, str | None] = {}
    made = [(pr, p, path_features(p)) for pr, p in rows]
    for pr, _, fs in made:
        for f in fs:
            of[f] = pr if of.setdefault(f, pr) == pr else None
    paths = {tuple(f for f in fs if of[f] is None) or (PATH_DIMS - 1,): owned_place(p) for _, p, fs in made}
    sizes = np.array([len(p) for p in paths], dtype=np.int64)
    at = np.array([k for p in paths for k in p], dtype=np.int64)
    return train_sparse(at, sizes, np.full(len(sizes), PATH_SCALE, dtype=np.float32), PATH_DIMS, float(sizes.max()) * PATH_SCALE**2, np.array([1.0 if v else -1.0 for v in paths.values()], dtype=np.float32), rounds=400)


def speaking(pattern: re.Pattern, text: str) -> set[bytes]:
    """The plain lines in which the pattern stands."""
    lines = set()
    for m in pattern.finditer(text):
        end = text.find("\n", m.end())
        lines.update(plain_lines(text[text.rfind("\n", 0, m.start()) + 1 : end if end >= 0 else len(text)]))
    return lines


def example(path: str, text: str, owner: str = OWNER) -> dict:
    """What training needs of one file, of a size that does not grow with the file's: its labels, lines and vector."""
    comments, own = comment_lines(path, text, owner)
    joined = "\n".join(x.decode("utf-8", "replace") for x in comments)
    tool, licence, code = speaking(_TOOL, joined), speaking(_LICENCE, joined), code_notice(text)
    noticed = bool(code or (tool or licence) and notices(path, text, owner))
    told = [noticed and (x in tool or not o and x in licence) for x, o in zip(comments, own)]
    raw, said = plain_lines(text), tool | licence | speaking(_TOOL, text) | speaking(_LICENCE, text)
    coded = speaking(_FOREIGN_CODE, text) if code else set()

    def picked(lines: list[bytes], named: np.ndarray, yes: list[bool]) -> list[tuple[bytes, float, bool]]:
        """Lines of notices first, then those that speak like them."""
        every = {(x[:LINE], float(o), bool(y), x in said) for x, o, y in zip(lines, named, yes) if len(x) > 3}
        return [r[:3] for r in sorted(every, key=lambda r: (not r[2], not r[3], zlib.crc32(r[0]), r))[:LINES]]

    plain = text.split("\n")
    vector = text_vector("\n".join(x for x, k in zip(plain, raw) if k not in said and k not in coded))
    at = np.nonzero(vector)[0].astype(np.int32)
    return {
        "place": owned_place(path), "shape": shape(text), "notice": noticed, "comments": picked(comments, own, told), "codes": picked(raw, np.zeros(len(raw)), [x in coded for x in raw]),
        "at": at.tobytes(), "value": vector[at].tobytes(),
    }


def part_of(project: str | None) -> int:
    """Which part of the repositories a project belongs to: 0 and 1 train, 2 sets thresholds, 3 reports."""
    return zlib.crc32((project or "").encode("utf-8", "replace")) % 4


def threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """MARGIN above the half-way below the last score down to which PRECISION of the files are labelled."""
    order = np.argsort(-scores, kind="stable")
    precise = np.nonzero(np.cumsum(y[order] > 0) / np.arange(1, len(order) + 1) >= PRECISION)[0]
    if not len(precise):
        return float("inf")
    ranked = np.append(scores[order], -1.0)
    return max((float(ranked[precise[-1]]) + float(ranked[precise[-1] + 1])) / 2, LEAST) + MARGIN


def fit(rows: list[tuple[str, str, dict]], paths: list[tuple[str, str]] = (), owner: str = OWNER) -> Model | None:
    """rows: (project, path, example); paths: (project, path) of further files. None if the labels are all of one kind."""
    y = np.array([1.0 if e["place"] or e["shape"] or e["notice"] else -1.0 for _, _, e in rows], dtype=np.float32)
    if len(rows) == 0 or abs(y.sum()) == len(y):
        return None
    part = np.array([part_of(p) for p, _, _ in rows])
    mixed = [len(set(y[k])) == 2 for k in (part < 2, part == 2, part == 3)]
    if not all(mixed):
        part = np.arange(len(rows)) % 4  # too few repositories to part by them
    fits, sets, reports = (np.nonzero(k)[0] for k in (part < 2, part == 2, part == 3))
    text = np.zeros((len(rows), TEXT_DIMS), dtype=np.float32)
    for k, (_, _, e) in enumerate(rows):
        text[k, np.frombuffer(e["at"], np.int32)] = np.frombuffer(e["value"], np.float32)
    lines = {}
    for name in ("comments", "codes"):
        known: dict[tuple[bytes, float], bool] = {}
        for k in fits:
            for x, o, told in rows[k][2][name]:
                known[(x, o)] = known.get((x, o), False) or told
        lines[name] = train_lines(list(known) or [(b"", 0.0)], np.array([1.0 if v else -1.0 for v in known.values()] or [-1.0], dtype=np.float32))
    placed = sorted({*((rows[k][0], rows[k][1]) for k in fits), *((pr, p) for pr, p in paths if all(mixed) and part_of(pr) < 2)})
    form = np.array([1.0 if e["shape"] else -1.0 for _, _, e in rows], dtype=np.float32)
    learnt = text[fits]
    model = Model(lines["comments"], lines["codes"], train_dense(learnt, y[fits]), train_dense(learnt, form[fits]), train_paths(placed), {}, owner, {})

    def scores(which: np.ndarray) -> np.ndarray:
        best = lambda m, e: float(m.lines([x for x, _, _ in e], np.array([o for _, o, _ in e], dtype=np.float32)).max()) if e else -1.0
        of_text = [text[which] @ m.weights + (m.bias - m.threshold) for m in (model.text, model.form)]
        return np.array([(best(model.comment, rows[k][2]["comments"]), best(model.code, rows[k][2]["codes"]), t, f, model.of_path(rows[k][1])) for k, t, f in zip(which, *of_text)]).reshape(-1, 5)

    s = scores(sets)
    for k, m in enumerate((model.comment, model.code, model.text, model.form, model.path)):
        m.threshold = threshold(s[:, k], y[sets])
    s = scores(sets)
    for name, of in (("notice", s[:, :2].max(1)), ("shape", s[:, 3]), ("place", s[:, 4])):
        least = np.sort(of[[bool(rows[k][2][name]) for k in sets]])
        # Too few labels to know how far down they reach: every file is in doubt.
        model.doubts[name] = min(0.0, float(least[int(len(least) * (1 - RECALL))])) - SLACK if len(least) >= FEW else float("-inf")
    s, true = scores(reports), y[reports] > 0
    sure = s.max(1) >= 0
    kept = sure | (s[:, :2].max(1) >= model.doubts["notice"]) | (s[:, 3] >= model.doubts["shape"]) | (s[:, 4] >= model.doubts["place"])
    ratio = lambda a, b: float(a.sum()) / max(1, int(b.sum()))
    model.report = {"files": len(reports), "labelled": int(true.sum()), "precision": ratio(true & sure, sure), "recall": ratio(true & sure, true), "recall_with_doubt": ratio(true & kept, true)}
    return model


def sample_of(files: DataFrame, size: int, n: int, salt: int) -> DataFrame:
    """About `size` of `n` rows by hash of the id: (file_id, project, path, content)."""
    rows = files.where(F.col("content").isNotNull() & (F.col("content") != "")) if salt == 11 else files
    keep = F.xxhash64("file_id", F.lit(salt)) / 2.0**64 + 0.5 < F.lit(min(1.0, size / max(1, n)))
    return rows.where(keep).select("file_id", F.coalesce(project_key(F.col("project")), F.lit("")).alias("project"), F.coalesce("file_path", F.lit("")).alias("file_path"), "content")


def train(files: DataFrame, size: int = SAMPLE, owner: str = OWNER) -> Model | None:
    """Examples are made where the files are read; `size` of them, each of bounded size, and PATHS paths come to the driver."""

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pickle.dumps(example(p, t, owner)) for p, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), b.column(2), pa.array(made, pa.binary())], ["file_id", "project", "path", "example"])

    n = files.count()  # from the files' footers, without reading contents
    rows = sample_of(files, size, n, 11).mapInArrow(examples, "file_id long, project string, path string, example binary")
    rows = rows.groupBy("file_id").agg(F.min(F.struct("project", "path", "example")).alias("m")).select("file_id", "m.*")
    paths = sample_of(files, PATHS, n, 12).select("project", "file_path").distinct()
    # Both bounded by the sizes of the samples.
    got = sorted(rows.collect(), key=lambda r: (r["file_id"] is not None, r["file_id"] or 0))
    return fit([(r["project"], r["path"], pickle.loads(r["example"])) for r in got], sorted(map(tuple, paths.collect())), owner)


def classify(files: DataFrame, model: Model | None = None, owner: str = OWNER) -> DataFrame:
    """(file_id, project, dotnet_project, score, checked, foreign) once per file that is a case; checked is null where the score decides."""
    if model is None:
        model = train(files, owner=owner)
    handle = files.sparkSession.sparkContext.broadcast(model)  # a weight per dimension, whatever the data
    rows = files.select("file_id", project_key(F.col("project")).alias("project"), "dotnet_project", F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("at"), F.coalesce("file_path", F.lit("")).alias("file_path"), "content")

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = handle.value
        for b in batches:
            cases = [(t is not None and bool(t.strip()), p, t) for p, t in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            said = [((m.verdict(p, t) if m else (0.0, confirmed(p, t, owner))) if case else (None, None)) for case, p, t in cases]
            scores, checked = [x for x, _ in said], [x for _, x in said]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(scores, pa.float64()), pa.array(checked, pa.bool_())], ["file_id", "project", "dotnet_project", "at", "score", "checked"])

    scored = rows.mapInArrow(verdicts, "file_id long, project string, dotnet_project string, at long, score double, checked boolean")
    last = F.max(F.struct("at", "score", "checked", "project", "dotnet_project")).alias("m")
    once = scored.groupBy("file_id").agg(last).select("file_id", "m.project", "m.dotnet_project", "m.score", "m.checked").where("score is not null")
    return once.withColumn("foreign", F.coalesce("checked", F.col("score") >= 0))
