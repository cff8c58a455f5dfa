"""Code blocks and import edges from source texts: Python by its own parser, TypeScript and JavaScript by a small scanner."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.paths import normalise, path_suffixes
from lattica.operators.store import with_block_ids
from lattica.sources.lexer import Code

#: Functions above this many lines get their nested functions as children, and references in their text (fixed value).
LARGE = 300

BLOCK_SCHEMA = "file_id long, ordinal int, type string, name string, content string, start_line int, end_line int, start_col int, end_col int, parent_ordinal int"


def _block(kind: str, name: str, content: str, pos: tuple[int, int, int, int], parent: int | None = None) -> dict:
    return {"type": kind, "name": name, "content": content, "start_line": pos[0], "end_line": pos[1], "start_col": pos[2], "end_col": pos[3], "parent_ordinal": parent}


def _names(target: ast.AST) -> list[str]:
    if isinstance(target, ast.Name):
        return [target.id]
    if isinstance(target, ast.Attribute):
        return [ast.unparse(target)]
    if isinstance(target, (ast.Tuple, ast.List)):
        return [n for x in target.elts for n in _names(x)]
    return _names(target.value) if isinstance(target, ast.Starred) else []


def python_blocks(text: str) -> list[dict]:
    """Enums, variables, functions at all depths, classes with methods and fields as children, imports, exports."""
    tree = ast.parse(text)
    rows = text.splitlines()
    out: list[dict] = []

    def pos(n: ast.AST) -> tuple[int, int, int, int]:
        return n.lineno, n.end_lineno, n.col_offset + 1, n.end_col_offset + 1

    def code(n: ast.AST) -> str:
        return ast.get_source_segment(text, n) or "\n".join(rows[n.lineno - 1 : n.end_lineno])

    def variables(nodes: list[ast.stmt], parent: int | None = None) -> None:
        for n in nodes:
            targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, (ast.AnnAssign, ast.AugAssign)) else []
            for name in (x for t in targets for x in _names(t)):
                if name == "__all__" and parent is None:
                    out.append(_block("export", name, code(n), pos(n)))
                else:
                    out.append(_block("variable", name, code(n), pos(n), parent))

    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def large(n: ast.AST, parent: int | None) -> int:
        """A function block; of a large one the nested functions become children, replaced by references."""
        at = len(out)
        out.append(_block("function", n.name, code(n), pos(n), parent))
        if n.end_lineno - n.lineno + 1 > LARGE:
            inner = [x for x in ast.walk(n) if isinstance(x, functions) and x is not n]
            body = rows[n.lineno - 1 : n.end_lineno]
            for x in sorted(inner, key=lambda x: x.lineno):
                out.append(_block("function", x.name, code(x), pos(x), at))
                body[x.lineno - n.lineno : x.end_lineno - n.lineno + 1] = [f"[BLOCK_REF:{len(out) - 1}]"] + [""] * (x.end_lineno - x.lineno)
            out[at]["content"] = "\n".join(x for x in body if x)
        return at

    for n in ast.walk(tree):
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            out.append(_block("import", ", ".join(a.asname or a.name for a in n.names), code(n), pos(n)))
        elif isinstance(n, ast.Call) and (name := ast.unparse(n.func)) in ("__import__", "importlib.import_module", "import_module") and n.args:
            out.append(_block("import", ast.unparse(n.args[0]).strip("'\""), code(n), pos(n)))
    variables(tree.body)
    out += [_block("variable", n.target.id, code(n), pos(n)) for n in ast.walk(tree) if isinstance(n, ast.NamedExpr)]
    methods: set[ast.AST] = set()
    nested: set[ast.AST] = set()
    for c in ast.walk(tree):
        if isinstance(c, ast.ClassDef):
            enum = any("Enum" in ast.unparse(b) for b in c.bases)
            at = len(out)
            out.append(_block("enum" if enum else "class", c.name, code(c) if enum else "", pos(c)))
            if not enum:
                for m in (x for x in c.body if isinstance(x, functions)):
                    methods.add(m)
                    large(m, at)
                variables(c.body, at)
            else:
                methods.update(x for x in c.body if isinstance(x, functions))
    for n in ast.walk(tree):
        if isinstance(n, functions) and n not in methods and n not in nested:
            if n.end_lineno - n.lineno + 1 > LARGE:
                nested.update(x for x in ast.walk(n) if isinstance(x, functions))
            large(n, None)
    return out


_ID = r"[A-Za-z_$][\w$]*"
_START = r"(?:^|(?<=[;{}]))[ \t]*"
_TS = (
    ("class", re.compile(rf"{_START}(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+({_ID})", re.M)),
    ("interface", re.compile(rf"{_START}(?:export\s+)?(?:declare\s+)?interface\s+({_ID})", re.M)),
    ("enum", re.compile(rf"{_START}(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+({_ID})", re.M)),
    ("type", re.compile(rf"{_START}(?:export\s+)?(?:declare\s+)?type\s+({_ID})[^=\n]*=", re.M)),
    ("function", re.compile(rf"{_START}(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_ID})", re.M)),
    ("variable", re.compile(rf"{_START}(?:export\s+)?(?:const|let|var)\s+(?!enum\b)({_ID}|\{{[^}}]*\}}|\[[^\]]*\])", re.M)),
    ("import", re.compile(_START + r"import\b[^;\n]*(?:\{[^}]*\}[^;\n]*)?", re.M)),
    ("export", re.compile(_START + r"export\b[^;\n{]*(?:\{[^}]*\}[^;\n]*)?", re.M)),
)
_PARAMS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_DECORATORS = re.compile(rf"(?:@{_ID}(?:\.{_ID})*(?:\s*{_PARAMS})?\s*)*")
_METHOD = re.compile(rf"(?:(?:public|private|protected|static|readonly|async|override|abstract|accessor|declare|get|set)\s+)*\*?\s*(#?{_ID}|\[[^\]:\n]*\])\s*[?!]?\s*(?:<[^>(]*>)?\s*(\()?")
_ARROW_VALUE = re.compile(rf"\s*(?:async\b\s*)?(?:<[^=()]*>\s*)?(?:{_PARAMS}\s*(?::[^=;{{}}]*)?|{_ID}\s*)=>\s*")
_GENERIC = re.compile(r"<[\w\s$.,\[\]|&'\"<>]*>\s*\(")
#: Brackets, ends and line breaks with the blanks around them (one match for a run of blanks).
_PIECE = re.compile(r"[\[{(]|[\]})]|=>|[=!<>]=+|[=:,;<>]|(?<!\s)\s*\n\s*")
_GOES_ON = re.compile(r"[.?:&|+*/,=<>){\]%^-]|(?:as|in|instanceof|satisfies)\b")
_WORDS = {"if", "for", "while", "switch", "return", "catch", "function", "constructor_", "new", "throw", "else", "do", "try", "await", "typeof", "case"}


def _close(blank: str, at: int) -> int:
    """End of the statement or block that begins at ``at``."""
    depth = 0
    for k in range(at, len(blank)):
        c = blank[k]
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth <= 0 and c == "}":
                return k + 1
        elif depth == 0 and c == ";":
            return k + 1
        elif depth == 0 and c == "\n" and re.match(r"\s*(?:$|\}|(?:export|import|const|let|var|function|class|interface|type|enum|async|abstract|declare)\b|@)", blank[k + 1 : k + 60]) and blank[at:k].strip() and not blank[at:k].rstrip().endswith(("=", "=>", ",", "(", "|", "&")):
            return k
    return len(blank)


def _breaks(blank: str, m: re.Match) -> bool:
    """A line break ends a statement unless one of its sides wants more."""
    before = blank[max(m.start() - 2, 0) : m.start()]
    return before in ("++", "--") or not (before.endswith(tuple("=,(|&+-*/?:<.")) or before == "=>" or _GOES_ON.match(blank, m.end()))


def _statement_end(blank: str, at: int) -> int:
    """End of a declaration: its semicolon, else a line break outside of brackets that ends it."""
    depth = 0
    for m in _PIECE.finditer(blank, at):
        if m[0] in ("[", "{", "("):
            depth += 1
        elif m[0] in ("]", "}", ")"):
            depth -= 1
            if depth < 0:
                return m.start()
        elif depth == 0 and m[0] == ";":
            return m.end()
        elif depth == 0 and "\n" in m[0] and _breaks(blank, m):
            return m.start()
    return len(blank)


def _declarators(blank: str, at: int, end: int) -> list[tuple[int, int, int | None]]:
    """(start, end, place of the equals sign) of each 'name: type = value' of a declaration, apart at commas outside of brackets and type arguments."""
    out: list[tuple[int, int, int | None]] = []
    depth, typed, value, skip = 0, False, None, at
    for m in _PIECE.finditer(blank, at, end):
        c = m[0]
        if m.start() < skip:
            continue
        if c in ("[", "{", "(") or c == "<" and typed:
            depth += 1
        elif c in ("]", "}", ")") or c == ">" and typed and depth:
            depth -= 1
        elif c == "<" and (g := _GENERIC.match(blank, m.start(), end)):
            skip = g.end() - 1
        elif depth == 0 and c == ":" and value is None:
            typed = True
        elif depth == 0 and c == "=" and value is None:
            typed, value = False, m.start()
        elif depth == 0 and c == ",":
            out.append((at, m.start(), value))
            at, typed, value = m.end(), False, None
    out.append((at, end, value))
    return [(s + len(blank[s:e]) - len(blank[s:e].lstrip()), e, v) for s, e, v in out]


def _members(blank: str, at: int, end: int) -> list[tuple[int, int, int | None]]:
    """(start, end, place of the equals sign) of each member of a class body; decorators belong to what follows them."""
    out: list[tuple[int, int, int | None]] = []
    depth, value = 0, None

    def close(b: int) -> None:
        nonlocal at, value
        s = at + len(blank[at:b]) - len(blank[at:b].lstrip())
        if s < b:
            out.append((s, b, value))
        at, value = b, None

    for m in _PIECE.finditer(blank, at, end):
        c = m[0]
        if c in ("[", "{", "("):
            depth += 1
        elif c in ("]", "}", ")"):
            depth -= 1
            if depth == 0 and c == "}" and value is None and not re.compile(r"\s*[{|&\[=;]").match(blank, m.end(), end):
                close(m.end())
        elif depth == 0 and c == "=" and value is None:
            value = m.start()
        elif depth == 0 and c == ";":
            close(m.end())
        elif depth == 0 and "\n" in c and _breaks(blank, m) and not _DECORATORS.fullmatch(blank[at : m.start()].lstrip()):
            close(m.start())
    close(end)
    return out


def _target_end(blank: str, at: int) -> int:
    """End of the name or pattern that begins at ``at``."""
    if blank[at : at + 1] not in ("{", "["):
        return m.end() if (m := re.compile(_ID).match(blank, at)) else at
    depth = 0
    for m in re.compile(r"[\[{(]|[\]})]").finditer(blank, at):
        depth += 1 if m[0] in "[{(" else -1
        if depth == 0:
            return m.end()
    return len(blank)


def pattern_names(pattern: str) -> list[str]:
    """Names that a destructuring pattern binds, in order."""
    if pattern[:1] not in "{[":
        return [pattern]
    out, parts, depth, at = [], [], 0, 1
    for m in re.finditer(r"[\[{(]|[\]})]|,", pattern):
        depth += (m[0] in "[{(") - (m[0] in "]})")
        if m[0] == "," and depth == 1 or depth == 0:
            parts.append(pattern[at : m.start()].strip())
            at = m.end()
    for part in parts:
        if pattern[0] == "{":
            part = re.sub(r"^[^:={\[]*:\s*", "", part)
        part = part.removeprefix("...").lstrip()
        target = part[: _target_end(part, 0)]
        out += pattern_names(target) if target else []
    return out



_ARROW = re.compile(rf"(?:\b({_ID})\s*(?::[^=;\n]*)?[=:]\s*)?(?:\basync\s*)?(?:{_PARAMS}\s*(?::[^=;{{}}\n]*)?|\b{_ID}\s*)=>\s*")
_INNER = re.compile(rf"(?:\basync\s+)?\bfunction\b\s*\*?\s*({_ID})?\s*(?:<[^>]*>)?\s*{_PARAMS}[^{{;]*\{{")
_MEMBER = re.compile(rf"(?:^|[{{}},;])\s*((?:(?:public|private|protected|static|override|async|get|set)\s+)*\*?({_ID})\s*(?:<[^>]*>)?\s*{_PARAMS}\s*(?::[^;{{}}=]*)?\{{)", re.M)


def _inner_functions(blank: str, a: int, b: int) -> list[tuple[int, int, int, str]]:
    """(start, end of the signature, end, name) of declarations, expressions, arrows and methods between two places, in order."""
    found = {}
    for m in _ARROW.finditer(blank, a, b):
        s = m.start() if not m[1] else m.end(1) + re.search(r"[=:]\s*(?=(?:async\b\s*)?(?:\(|[\w$]+\s*=>))", blank[m.end(1) : m.end()]).end()
        block = blank[m.end() : m.end() + 1] == "{"
        found[s] = (s, m.end() + block, _close(blank, m.end()) if block else _expression_end(blank, m.end(), b), m[1] or "anonymous")
    for m in _INNER.finditer(blank, a, b):
        found[m.start()] = (m.start(), m.end(), _close(blank, m.end() - 1), m[1] or "anonymous")
    for m in _MEMBER.finditer(blank, a, b):
        if m[2] not in _WORDS:
            found.setdefault(m.start(1), (m.start(1), m.end(1), _close(blank, m.end(1) - 1), m[2]))
    return [found[s] for s in sorted(found)]


def _expression_end(blank: str, at: int, last: int) -> int:
    """End of an arrow's body without braces."""
    depth = 0
    for k in range(at, last):
        c = blank[k]
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth < 0:
                return k
        elif depth == 0 and (c in ",;" or c == "\n" and blank[at:k].strip() and not re.match(r"\s*[.?:&|+*/-]", blank[k:last])):
            return k
    return last


def typescript_blocks(text: str) -> list[dict]:
    """Imports, exports, functions, classes with members, interfaces, types, enums and variables of TS, TSX, JS.

    Of a large function or method the functions inside become children, and their bodies references in its text;
    arrows without braces stay in the text.
    """
    lexed = Code(text)
    blank = lexed.blank
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    import bisect

    def pos(a: int, b: int) -> tuple[int, int, int, int]:
        i, j = bisect.bisect_right(starts, a) - 1, bisect.bisect_right(starts, max(a, b - 1)) - 1
        return i + 1, j + 1, a - starts[i] + 1, b - starts[j] + 1

    out: list[dict] = []
    inside = bytearray(len(text))
    is_large = lambda a, b: (p := pos(a, b))[1] - p[0] + 1 > LARGE

    def function(name: str, a: int, b: int, after: int, parent: int | None = None) -> None:
        """A function block whose signature goes on at ``after``."""
        at = len(out)
        out.append(_block("function", name, text[a:b], pos(a, b), parent))
        if not is_large(a, b):
            return
        parts, cut, shown = [], a, (0, 0)
        for s, signed, e, inner in _inner_functions(blank, after, b):
            out.append(_block("function", inner, text[s:e], pos(s, e), at))
            reference = f"\n    // [BLOCK_REF:{len(out) - 1}]\n"
            if s < shown[1]:
                parts[-1] = parts[-1].removesuffix("}") + reference.removeprefix("\n") + "}"
            elif blank[signed - 1] == "{":
                parts += [text[cut:signed], reference + "}"]
                cut, shown = e, (s, e)
        out[at]["content"] = "".join([*parts, text[cut:b]])

    def hide(a: int, b: int) -> None:
        """Functions that begin between two places are told by what holds them."""
        inside[a + 1 : b] = b"\1" * (b - a - 1)

    for m in _TS[5][1].finditer(blank):
        a = m.start() + len(m[0]) - len(m[0].lstrip())
        if lexed.depth(a) == 0 and is_large(a, b := _statement_end(blank, a)) and any(v and _ARROW_VALUE.match(blank, v + 1, e) for _, e, v in _declarators(blank, m.start(1), b)):
            hide(a, b)
    for kind, rx in _TS:
        for m in rx.finditer(blank):
            a = m.start() + len(m[0]) - len(m[0].lstrip())
            if kind in ("variable", "import", "export") and lexed.depth(a) > 0:
                continue
            b = m.end() if kind in ("import", "export") else _statement_end(blank, m.start(1)) if kind == "variable" else _close(blank, a)
            if kind == "import":
                names = re.findall(_ID, re.sub(r"\bfrom\b.*|\bimport\b|\btype\b|\bas\b", " ", text[a:b], flags=re.S)) or [text[a:b].split()[-1].strip("'\";")]
                out.append(_block("import", ", ".join(names), text[a:b], pos(a, b)))
            elif kind == "export":
                names = re.findall(_ID, re.sub(r"\b(?:export|default|const|let|var|function|class|interface|enum|type|async|abstract|declare|from|as)\b|[=(<:].*", " ", blank[a:b], flags=re.S))
                out.append(_block("export", ", ".join(names) or "default", text[a:b], pos(a, b)))
            elif kind == "variable":
                for s, e, v in _declarators(blank, m.start(1), b):
                    arrow = _ARROW_VALUE.match(blank, v + 1, e) if v else None
                    for name in pattern_names(text[s : _target_end(blank, s)]):
                        if arrow:
                            function(name, a, b, arrow.end())
                        else:
                            out.append(_block("variable", name, text[a:b], pos(a, b)))
            elif kind == "class":
                at = len(out)
                out.append(_block("class", m[1], "", pos(a, b)))
                hide(a, b)
                body = blank.find("{", m.end())
                for s, e, v in _members(blank, body + 1, b - 1):
                    bare = _DECORATORS.match(blank, s, e).end()
                    f = _METHOD.match(blank, bare, e)
                    if f is None or f[1] in _WORDS or f[1] == "static":
                        continue
                    if f[2] and (v is None or f.end() <= v):
                        function(f[1], bare, e, f.end(), at)
                    elif v and re.compile(r"=>|\bfunction\b").search(blank, v + 1, e):
                        function(f[1], s, e, v + 1, at)
                    else:
                        out.append(_block("variable", text[slice(*f.span(1))], text[s:e], pos(s, e), at))
            elif kind == "function" and inside[a]:
                continue
            elif kind == "function":
                function(m[1], a, b, m.end())
                if is_large(a, b):
                    hide(a, b)
            else:
                out.append(_block(kind, m[1], text[a:b], pos(a, b)))
    for m in re.finditer(r"\b(?:require|import)\s*\(\s*(['\"])", blank):
        end = blank.find(m[1], m.end())
        out.append(_block("import", text[m.end() : end], text[m.start() : end + 2], pos(m.start(), end + 2)))
    return out


#: Extractors by language; more may be registered.
EXTRACTORS: dict[str, Callable[[str], list[dict]]] = {"python": python_blocks, "typescript": typescript_blocks, "tsx": typescript_blocks, "javascript": typescript_blocks}


def register(language: str, extractor: Callable[[str], list[dict]]) -> None:
    EXTRACTORS[language] = extractor


def blocks_of(language: str | None, text: str | None, extractors: dict[str, Callable[[str], list[dict]]] | None = None) -> list[dict]:
    """Blocks of a text in extraction order; none for unknown languages and for texts that don't parse."""
    run = (EXTRACTORS if extractors is None else extractors).get(language or "")
    if run is None or not text:
        return []
    try:
        return run(text)
    except (SyntaxError, ValueError, RecursionError):
        return []


def extract_blocks(files: DataFrame) -> DataFrame:
    """Blocks of files (id, language, content) with ordinals from 1, ``id`` and ``parent_block_id``; a block's key is (file_id, ordinal).

    The extractors registered when this is called travel with the plan, so workers know them too.
    """
    extractors = dict(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, lang, text in zip(batch["id"], batch["language"], batch["content"], strict=True):
                for k, b in enumerate(blocks_of(lang, text, extractors)):
                    parent = None if b["parent_ordinal"] is None else b["parent_ordinal"] + 1
                    rows.append({"file_id": i, "ordinal": k + 1, **b, "parent_ordinal": parent})
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])
            yield out.astype({"parent_ordinal": "Int32"})

    return with_block_ids(files.select("id", "language", "content").mapInPandas(run, BLOCK_SCHEMA))


# --- imports

IMPORT = T.ArrayType(
    T.StructType().add("module", T.StringType()).add("symbols", T.ArrayType(T.StringType())).add("level", T.IntegerType()).add("content", T.StringType())
)


def python_imports(text: str) -> list[dict]:
    out = []
    for n in ast.walk(ast.parse(text)):
        code = ast.get_source_segment(text, n) if isinstance(n, (ast.Import, ast.ImportFrom, ast.Call)) else None
        if isinstance(n, ast.Import):
            out += [{"module": a.name, "symbols": [a.asname or a.name], "level": 0, "content": code} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            names = [a.name for a in n.names]
            if n.module:
                out.append({"module": n.module, "symbols": names, "level": n.level, "content": code})
            else:
                out += [{"module": a, "symbols": [a], "level": n.level, "content": code} for a in names]
        elif isinstance(n, ast.Call) and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str) and ast.unparse(n.func) in ("__import__", "importlib.import_module", "import_module"):
            out.append({"module": n.args[0].value.lstrip("."), "symbols": [], "level": len(n.args[0].value) - len(n.args[0].value.lstrip(".")), "content": code})
    return out


_QUOTED = r"(?P<q>['\"])(?P<module>\s*)(?P=q)"
_FROM = re.compile(rf"\b(?:import|export)\b(?P<clause>(?:(?!\b(?:import|export|from)\b)[\w$\s,{{}}*])*)\bfrom\s*{_QUOTED}|\bimport\s*{_QUOTED.replace('<q>', '<r>').replace('=q', '=r').replace('<module>', '<side>')}")
_CALLED = re.compile(rf"\b(?:require|import)\s*\(\s*{_QUOTED}")


def typescript_imports(text: str) -> list[dict]:
    """Imports, re-exports and require calls of the code, in order; what strings and comments say is none."""
    blank = Code(text).blank
    found = []
    for m in _FROM.finditer(blank):
        at = m.span("module") if m["q"] else m.span("side")
        found.append((m.start(), m.end(), m["clause"] or "", text[slice(*at)]))
    last = 0
    for m in _CALLED.finditer(blank):
        left = re.sub(r"\bawait$", "", blank[last : m.start()].rstrip()).rstrip()
        start, clause = m.start(), ""
        if left.endswith("="):
            left = left[:-1].rstrip()
            k = left.rfind("{") if left.endswith("}") else len(left) - len(re.match(r"[\w$]*", left[::-1])[0])
            clause = left[k:]
            start = last + k
            if d := re.search(r"\b(?:const|let|var)\s+$", blank[max(last, start - 16) : start]):
                start -= len(d[0])
        found.append((start, m.end(), clause, text[slice(*m.span("module"))]))
        last = m.end()
    out = []
    for a, b, clause, module in sorted(found):
        names = [x for x in re.findall(_ID, clause) if x not in ("as", "type", "const", "let", "var", "from")]
        out.append({"module": module, "symbols": names, "level": 1 if module.startswith(".") else 0, "content": text[a:b]})
    return out


@F.pandas_udf(IMPORT)
def imports(language: pd.Series, text: pd.Series) -> pd.Series:
    def run(lang: str, t: str) -> list[dict]:
        try:
            return python_imports(t) if lang == "python" else typescript_imports(t) if lang in ("typescript", "tsx", "javascript") else []
        except (SyntaxError, ValueError, RecursionError):
            return []

    return pd.Series([run(a, b or "") for a, b in zip(language, text, strict=True)])


def module_registry(files: DataFrame) -> DataFrame:
    """(module, file_id): each dotted path suffix of the Python files; the last path of equals."""
    each = files.filter("language = 'python'").select("id", "file_path", F.explode(path_suffixes("file_path")).alias("module"))
    return each.groupBy("module").agg(F.max_by("id", F.struct("file_path", "id")).alias("file_id"))


def import_edges(files: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Relationships (source_id, target_id, import_content, symbols, type) of files (id, file_path, language, content).

    Imports lead to ``targets`` (by default the files themselves), whose contents aren't parsed.
    Python modules meet the registry by equality: relative ones by the absolute path they name, others by
    their full dotted name, so a match ends at a component. TypeScript and JavaScript candidates (suffixes
    and index files, either language) meet file paths by equality; the first candidate wins.
    """
    targets = files if targets is None else targets
    found = files.select("id", "file_path", "language", F.explode(imports("language", "content")).alias("i")).select("id", "file_path", "language", "i.*")
    parts = F.split(F.regexp_replace(F.ltrim("file_path", F.lit("/")), "/[^/]*$", ""), "/")
    py = found.filter("language = 'python'")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("level") + 1, F.lit(0))), ".")
    tries = F.when(F.col("level") > 0, F.array(F.concat_ws(".", F.nullif(base, F.lit("")), "module"))).otherwise(
        F.concat(F.array("module"), F.transform("symbols", lambda s: F.concat(F.col("module"), F.lit("."), s)))
    )
    py_try = py.select("id", "content", "symbols", F.explode(tries).alias("module")).join(module_registry(targets), "module").select("id", "content", "symbols", F.col("file_id").alias("target"), F.lit(0).alias("rank"))
    js = found.filter("language IN ('typescript', 'tsx', 'javascript') AND level > 0")
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    stem = normalise(F.concat(folder, F.lit("/"), F.col("module")))
    ends = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    js_try = js.select("id", "content", "symbols", F.posexplode(F.array(*[F.concat(stem, F.lit(e)) for e in ends])).alias("rank", "at"))
    js_hit = js_try.join(targets.select(F.col("id").alias("target"), F.col("file_path").alias("at")), "at").select("id", "content", "symbols", "target", "rank")
    hits = py_try.unionByName(js_hit).filter("id <> target")
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy("id", "content", F.when(F.col("rank") == 0, F.col("target")).otherwise(-1)).orderBy("rank"))).filter("k = 1")
    return first.groupBy(F.col("id").alias("source_id"), F.col("target").alias("target_id")).agg(
        F.min("content").alias("import_content"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("symbols"), F.lit("import").alias("type")
    )
