"""Symbols of brace languages from their tokens and scopes: true end lines, calls, bases and imports, without grammars.

A source is cut into tokens, comments gone and strings whole; brackets are matched; then one walk keeps a stack of scopes.
What stands where declarations go (a file, a class, a namespace) is read as declarations, what stands in code as calls.  A call
counts for every function that it stands in.  Damaged sources give what can be read.
"""

from __future__ import annotations

import re

_STRING = r'"(?:[^"\\\n]|\\.)*"'
_NAME = r"[A-Za-z_$\u0080-\U0010ffff][\w$]*"
_OPS = r"=>|->|::|\?\.|&&|\|\||[^\s\w]"
_COMMENT = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)"
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_QUOTED = r"'(?:[^'\\\n]|\\.)*'"
#: What else than comments, plain strings, names, numbers and marks a language's source holds.
_SPECIAL = {
    "javascript": _QUOTED,
    "go": r"`[^`]*`|" + _QUOTED,
    "rust": r'b?r(?P<hash>#*)"(?s:.*?)"(?P=hash)|b?\'(?:\\[^\n]*?|[^\\\n])\'|\'[A-Za-z_]\w*',
    "java": r'"""(?s:.*?)"""|' + _QUOTED,
    "cpp": r'R"(?P<fence>[^()\s\\]{0,16})\((?s:.*?)\)(?P=fence)"|' + _QUOTED,
}
_TOKENS = {
    language: re.compile(rf"(?P<skip>\s+|{_COMMENT})|(?P<str>{special}|{_STRING})|(?P<id>{_NAME})|(?P<num>\d[\w.]*)|(?P<op>{_OPS})")
    for language, special in _SPECIAL.items()
}
_TOKENS["typescript"] = _TOKENS["tsx"] = _TOKENS["javascript"]
LANGUAGES = frozenset(_TOKENS)
_SCRIPT = frozenset({"javascript", "typescript", "tsx"})

_CLASSES = {
    "javascript": ("class", "interface", "enum"), "go": (), "rust": ("struct", "enum", "trait", "union"), "java": ("class", "interface", "enum", "record"), "cpp": ("class", "struct", "enum", "union"),
}
#: Names before a bracket that are neither calls nor declarations.
_WORDS = {
    "javascript": frozenset("if for while switch catch return else do new delete typeof instanceof in of await yield throw case function class super void async let const var import export".split()),
    "go": frozenset("if for switch return else case func go defer select range map chan struct interface type var const import".split()),
    "rust": frozenset("if for while match loop return else in fn impl struct enum trait unsafe move where as dyn mut ref pub let async await".split()),
    "java": frozenset("if for while switch catch return else do new throw case synchronized try super this class".split()),
    "cpp": frozenset("if for while switch catch return else do new delete throw case sizeof alignof decltype static_assert noexcept typeid alignas defined".split()),
}
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do await yield".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class _Source:
    """Tokens with their kinds and lines, and the index of each bracket's partner."""

    def __init__(self, text: str, language: str) -> None:
        self.language = "javascript" if language in _SCRIPT else language
        self.kind: list[str] = []
        self.text: list[str] = []
        self.line: list[int] = []
        self.included: list[str] = []
        self._cut(text)
        self.partner = self._match()

    def _add(self, kind: str, text: str, line: int) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.line.append(line)

    def _cut(self, source: str) -> None:
        pattern, at, line, holes = _TOKENS[self.language], 0, 1, []
        if self.language == "cpp":  # directives go, their lines stay
            self.included = re.findall(r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', source)
            source = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: "\n" * m[0].count("\n"), source)
        while at < len(source):
            mark = source[at]
            if self.language == "javascript":
                if mark == "`" or (mark == "}" and holes and holes[-1] == 0):  # a template's text, up to its end or next hole
                    if mark == "}":
                        holes.pop()
                    end = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{|\Z)", re.DOTALL).match(source, at + 1)
                    self._add("str", "``", line)
                    line += source.count("\n", at, end.end())
                    at = end.end()
                    if end[1] == "${":
                        holes.append(0)
                    continue
                if holes and mark in "{}":
                    holes[-1] += 1 if mark == "{" else -1
                if mark == "/" and source[at + 1 : at + 2] not in ("/", "*") and (not self.kind or self.kind[-1] == "op" and self.text[-1] not in (")", "]", "}") or self.text[-1] in _BEFORE_REGEX) and (found := _REGEX.match(source, at)):
                    self._add("str", "//", line)
                    at = found.end()
                    continue
            if self.language == "rust" and source.startswith("/*", at):  # comments nest
                depth, end = 0, at
                for m in re.compile(r"/\*|\*/").finditer(source, at):
                    depth += 1 if m[0] == "/*" else -1
                    end = m.end()
                    if depth == 0:
                        break
                else:
                    end = len(source)
                line += source.count("\n", at, end)
                at = end
                continue
            found = pattern.match(source, at)
            if found is None:
                at += 1
                continue
            if found.lastgroup != "skip":
                self._add(found.lastgroup, found[0], line)  # the group that closed last, not one within it
            line += source.count("\n", at, found.end())
            at = found.end()

    def _match(self) -> dict[int, int]:
        partner, stack = {}, []
        for i, (kind, text) in enumerate(zip(self.kind, self.text, strict=True)):
            if kind != "op":
                continue
            if text in _OPEN:
                stack.append(i)
            elif text in _CLOSE and any(_OPEN[self.text[j]] == text for j in stack):
                while stack:
                    j = stack.pop()
                    partner[j] = i
                    if _OPEN[self.text[j]] == text:
                        break
        return partner | dict.fromkeys(stack, len(self.text) - 1)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "id"

    def close(self, i: int) -> int:
        return self.partner.get(i, i)

    def angles(self, i: int) -> int:
        """The token after a list in angle brackets that begins at ``i``, or ``i`` where none does."""
        if self.at(i) != "<":
            return i
        depth = 0
        for j in range(i, min(i + 200, len(self.text))):
            depth += (self.text[j] == "<") - (self.text[j] == ">")
            if depth == 0:
                return j + 1
            if self.text[j] in (";", "{"):
                break
        return i

    def value(self, i: int) -> str:
        return self.text[i].strip("\"'`")


def _bases(s: _Source, i: int, stop: int) -> list[str]:
    """Last names of the types listed from ``i`` to ``stop``, without what stands in angle brackets."""
    out, last = [], ""
    while i < stop:
        if s.text[i] == "<" and (after := s.angles(i)) > i:
            i = after
            continue
        if s.named(i) and s.text[i] not in ("public", "private", "protected", "virtual", "extends", "implements", "final", "where"):
            last = s.text[i]
        elif s.text[i] in (",", "+") or s.text[i] in ("extends", "implements", "where"):
            if last:
                out.append(last)
            last = ""
            if s.text[i] == "where":
                break
        i += 1
    return list(dict.fromkeys([*out, last] if last else out))


class _Walk:
    def __init__(self, s: _Source) -> None:
        self.s, self.symbols, self.imports = s, [], list(s.included)
        self.declares: set[int] = set()  # brackets within which declarations stand
        self.names: set[int] = set()  # tokens that name what is declared

    def _symbol(self, name: int, kind: str, start: int, end: int, bases: list[str] | None = None) -> None:
        s = self.s
        self.names.add(name)
        self.symbols.append({"name": s.text[name], "type": kind, "start_line": s.line[start], "end_line": s.line[min(end, len(s.line) - 1)], "docstring": "", "calls": [], "decorators": [], "tags": [], "bases": bases or [], "span": (start, end)})

    def _until(self, i: int, marks: tuple[str, ...]) -> int:
        """The next of some marks outside inner brackets, or the end."""
        s = self.s
        while i < len(s.text):
            if s.kind[i] == "op" and s.text[i] in marks:
                return i
            if s.kind[i] == "op" and s.text[i] in _CLOSE:
                return i
            i = s.close(i) + 1 if s.kind[i] == "op" and s.text[i] in _OPEN else i + 1
        return i

    def _class(self, i: int) -> None:
        """A class-like declaration whose keyword is at ``i``."""
        s, name = self.s, i + 1
        if s.language == "cpp":
            while s.at(name) in ("class", "struct", "alignas") or s.at(name) == "[":
                name = s.close(name) + 1 if s.at(name) == "[" else name + 1
        if not s.named(name):
            return
        stop = self._until(name + 1, ("{", ";", "(") if s.language in ("rust", "java", "cpp") else ("{", ";"))
        if s.language in ("rust", "java") and s.at(stop) == "(":  # a record, or a struct of unnamed fields
            stop = self._until(s.close(stop) + 1, ("{", ";"))
        if s.language == "cpp" and (s.at(stop) != "{" or s.at(name + 1) not in ("{", ":", "final", "<")):
            return
        after, bases = s.angles(name + 1), []
        head = s.text[after:stop]
        if s.language == "cpp" and ":" in head and s.text[i] != "enum":
            bases = _bases(s, after + head.index(":") + 1, stop)
        elif s.language == "rust":
            bases = _bases(s, after + 1, stop) if s.text[i] == "trait" and s.at(after) == ":" else []
        elif s.language in ("java", "javascript"):
            found = [k for k in ("extends", "implements") if k in head]
            bases = _bases(s, after + min(head.index(k) for k in found) + 1, stop) if found else []
        if s.at(stop) == "{" and s.text[i] != "enum" or s.at(stop) == "{" and s.language == "java":
            self.declares.add(stop)
        self._symbol(name, "CLASS", i, s.close(stop), bases)

    def _body(self, i: int) -> int | None:
        """The opening brace of a function whose parameters close at ``i``; none where it is only declared or called."""
        s = self.s
        if s.language in ("go", "rust"):
            stop = self._until(i + 1, ("{", ";"))
            while s.language == "go" and s.at(stop) == "{" and s.at(stop - 1) in ("struct", "interface"):  # a type among the results
                stop = self._until(s.close(stop) + 1, ("{", ";"))
            return stop if s.at(stop) == "{" else None
        j = i + 1
        while j < len(s.text) and (s.named(j) or s.text[j] in (":", "->", "::", "<", ">", "[", "]", "|", "&", "*", ",", ".", "(", "&&", "?", "=>") or s.kind[j] == "str"):
            if s.text[j] == "=>":
                return None
            if s.language == "java" and s.named(j) and s.text[j] != "throws" and s.at(i + 1) != "throws":
                return None
            if s.language == "cpp" and s.text[j] == ":":  # initialisers: name(...) or name{...}, by commas
                j += 1
                while s.named(j):
                    while s.named(j) or s.at(j) == "::":
                        j += 1
                    j = s.angles(j)
                    if s.at(j) not in ("(", "{"):
                        return None
                    j = s.close(j) + 1
                    if s.at(j) == ",":
                        j += 1
                break
            if s.language == "javascript" and s.text[j] == ":" and s.at(j + 1) == "{":  # an object as the type of what is returned
                j = s.close(j + 1) + 1
                continue
            j = s.close(j) + 1 if s.text[j] in ("(", "[") else j + 1
        return j if s.at(j) == "{" else None

    def _arrow(self, i: int) -> int | None:
        """The token after ``=>`` of an arrow function that begins at ``i``."""
        s = self.s
        i += s.at(i) == "async"
        if s.at(i) == "<":
            i = s.angles(i)
        if s.named(i) and s.at(i + 1) == "=>":
            return i + 2
        if s.at(i) == "(":
            j = s.close(i) + 1
            if s.at(j) == ":":
                j = self._until(j + 1, ("=>", ";", "="))
            if s.at(j) == "=>":
                return j + 1
        return None

    def _script(self, i: int) -> None:
        s, text = self.s, self.s.text[i]
        if text == "function":
            name = i + 1 + (s.at(i + 1) == "*")
            params = self._until(name, ("(",))
            body = self._body(s.close(params)) if s.at(params) == "(" else None
            if body is not None and s.named(name):
                self._symbol(name, "FUNCTION", i, s.close(body))
        elif text in ("const", "let", "var") and s.named(i + 1):
            equals = self._until(i + 2, ("=", ";", ",")) if s.at(i + 2) == ":" else i + 2
            if s.at(equals) == "=":
                self._assigned(i + 1, equals, i)
        elif text in ("import", "export") or text == "require" and s.at(i + 1) == "(":
            if s.at(i + 1) == "(" and i + 2 < len(s.text) and s.kind[i + 2] == "str":
                self.imports.append(s.value(i + 2))
            elif text == "import" and i + 1 < len(s.text) and s.kind[i + 1] == "str":
                self.imports.append(s.value(i + 1))
            elif text == "import" or s.at(i + 1) in ("{", "*", "type"):
                for j in range(i + 1, min(i + 400, len(s.text) - 1)):
                    if s.text[j] == ";" or (j > i + 1 and s.text[j] in ("import", "export")):
                        break
                    if s.text[j] == "from" and s.kind[j + 1] == "str":
                        self.imports.append(s.value(j + 1))
                        break

    def _assigned(self, name: int, equals: int, start: int) -> None:
        s, value = self.s, equals + 1
        body = self._arrow(value)
        if body is not None:
            self._symbol(name, "FUNCTION", start, s.close(body) if s.at(body) == "{" else max(body, self._until(body, (";", ",")) - 1))
        elif s.at(value + (s.at(value) == "async")) == "function" and not s.named(value + 1 + (s.at(value) == "async")):
            params = self._until(value, ("(",))
            if (open_ := self._body(s.close(params))) is not None:
                self._symbol(name, "FUNCTION", start, s.close(open_))

    def _go(self, i: int) -> None:
        s, text = self.s, self.s.text[i]
        if text == "func":
            name = s.close(i + 1) + 1 if s.at(i + 1) == "(" else i + 1
            params = s.close(name + 1) + 1 if s.at(name + 1) == "[" else name + 1
            if s.named(name) and s.at(params) == "(" and (body := self._body(s.close(params))) is not None:
                self._symbol(name, "FUNCTION", i, s.close(body))
        elif text == "type":
            inside = s.at(i + 1) == "("
            j, stop = (i + 2, s.close(i + 1)) if inside else (i + 1, i + 2)
            while j < stop and s.named(j):
                value = s.close(j + 1) + 1 if s.at(j + 1) == "[" and s.line[s.close(j + 1)] == s.line[j] and s.at(s.close(j + 1) + 1) in ("struct", "interface") else j + 1
                if s.at(value) in ("struct", "interface") and s.at(value + 1) == "{":
                    end, bases, k = s.close(value + 1), [], value + 2
                    while k < end:  # a line of one type alone embeds it
                        row = [k]
                        while row[-1] + 1 < end and s.line[row[-1] + 1] == s.line[k]:
                            row.append(row[-1] + 1)
                        if all(s.named(x) or s.text[x] in ("*", ".") for x in row) and sum(map(s.named, row)) == 1 + sum(s.text[x] == "." for x in row):
                            bases.append(s.text[row[-1]])
                        k = max([row[-1], *(s.close(x) for x in row if s.text[x] in _OPEN)]) + 1
                else:
                    bases, end = [], value
                    while end + 1 < len(s.text) and s.line[end + 1] == s.line[value]:
                        end += 1
                self._symbol(j, "CLASS", i if not inside else j, end, bases)
                j = end + 1
        elif text == "import":
            for j in range(i + 1, s.close(i + 1) + 1 if s.at(i + 1) == "(" else min(i + 3, len(s.text))):
                if s.kind[j] == "str":
                    self.imports.append(s.value(j))
                    if s.at(i + 1) != "(":
                        break

    def _rust(self, i: int) -> None:
        s, text = self.s, self.s.text[i]
        if text == "fn" and s.named(i + 1):
            params = s.angles(i + 2)
            if s.at(params) == "(":
                body = self._body(s.close(params))
                self._symbol(i + 1, "FUNCTION", i, s.close(body) if body is not None else self._until(params, (";",)))
        elif text in ("impl", "mod"):
            stop = self._until(i + 1, ("{", ";"))
            if s.at(stop) == "{":
                self.declares.add(stop)
            if text == "mod" and s.at(stop) == ";":
                self.imports.append(s.at(i + 1))
            head = range(s.angles(i + 1), stop)
            if text == "impl" and (of := next((j for j in head if s.text[j] == "for"), None)) is not None:
                trait, target = _bases(s, head.start, of), _bases(s, of + 1, stop)
                self.given = [*getattr(self, "given", []), (target, trait)]
        elif text == "use":
            stop = self._until(i + 1, (";",))
            path = s.text[i + 1 : stop]
            upto = next((k for k, t in enumerate(path) if t in ("{", "*", "as")), len(path))
            self.imports.append("".join(path[:upto]).removesuffix("::"))

    def run(self) -> tuple[list[dict], list[str]]:
        s, scopes, words, body = self.s, [(len(self.s.text), True)], _WORDS[self.s.language], None
        inside = -1  # up to here go the parameters, types and initialisers of a function that is known
        each = {"javascript": self._script, "go": self._go, "rust": self._rust}.get(s.language)
        calls: list[tuple[int, str]] = []
        for i, text in enumerate(s.text):
            while i > scopes[-1][0]:
                scopes.pop()
            declares = scopes[-1][1]
            if s.kind[i] == "op":
                if text == "{":
                    scopes.append((s.close(i), i in self.declares))
                continue
            if s.kind[i] != "id" or i < inside:
                continue
            if s.at(i - 1) in (".", "?."):
                if s.at(s.angles(i + 1)) == "(" or s.language == "rust" and s.at(i + 1) == "::" and s.at(s.angles(i + 2)) == "(":
                    calls.append((i, text))
                continue
            if text in _CLASSES[s.language] and i not in self.names and s.at(i - 1) != "enum":
                self._class(i)
            if each:
                each(i)
            elif text == "import" and s.language == "java":
                self.imports.append("".join(t for t in s.text[i + 1 : self._until(i, (";",))] if t != "static"))
            elif text in ("namespace", "extern") and s.language == "cpp":
                stop = self._until(i + 1, ("{", ";", "(", "="))
                if s.at(stop) == "{":
                    self.declares.add(stop)
            if i in self.names:
                continue
            after = s.angles(i + 1 + (s.language == "rust" and s.at(i + 1) == "::" and s.at(i + 2) == "<"))
            if s.at(after) == "(" and text not in words:
                in_class = declares and len(scopes) > 1
                if s.language == "javascript" and in_class or declares and s.language in ("java", "cpp"):
                    body = self._body(s.close(after))
                    if body is not None:
                        start = i
                        while start > 0 and s.line[start - 1] == s.line[i] and s.text[start - 1] not in ("{", "}", ";", ")"):
                            start -= 1
                        self._symbol(i, "FUNCTION", start, s.close(body))
                        inside = body
                        continue
                    if s.language != "javascript" and (s.named(i - 1) or s.at(i - 1) in (">", "*", "&", "]")):
                        continue  # a method without a body
                calls.append((i, text))
            elif s.language == "javascript" and declares and len(scopes) > 1 and s.at(i + 1) in ("=", ":") and text not in words:
                equals = i + 1 if s.at(i + 1) == "=" else self._until(i + 2, ("=", ";", "{"))
                if s.at(equals) == "=":
                    self._assigned(i, equals, i)
        return self._finished(calls)

    def _finished(self, calls: list[tuple[int, str]]) -> tuple[list[dict], list[str]]:
        self.symbols.sort(key=lambda x: (x["span"][0], -x["span"][1]))
        open_: list[dict] = []
        waiting = iter(self.symbols)
        following = next(waiting, None)
        for at, name in calls:
            while following is not None and following["span"][0] < at:
                open_.append(following)
                following = next(waiting, None)
            open_ = [x for x in open_ if x["span"][1] >= at]
            for x in open_:
                if x["type"] == "FUNCTION" and at not in self.names and name not in x["calls"]:
                    x["calls"].append(name)
        classes = {x["name"]: x for x in self.symbols if x["type"] == "CLASS"}
        for target, trait in getattr(self, "given", []):
            if target and trait and (x := classes.get(target[-1])) is not None and trait[-1] not in x["bases"]:
                x["bases"].append(trait[-1])
        for x in self.symbols:
            del x["span"]
        return self.symbols, list(dict.fromkeys(self.imports))


def parse(source: str, language: str) -> tuple[list[dict], list[str]]:
    """Symbols and imported modules of a source in one of ``LANGUAGES``."""
    return _Walk(_Source(source, language)).run()
