"""A tolerant parser for C that yields the events the analysis works on.

It reads bytes (one Latin-1 character each, so that offsets are byte offsets), skips comments and
preprocessor lines, and builds only the node kinds the rules look at. Whatever it can't read is
skipped to the next ; or }.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<blank>[ \t\r\n\f\v]+|\\\r?\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>(?:u8|[LuU])?"(?:\\.|[^"\\\n])*"?)|(?P<char>(?:[LuU])?'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<name>[A-Za-z_\x80-\xff$][\w\x80-\xff$]*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[][(){};:,.?~!<>=+\-*/%&|^])|(?P<other>.)""",
    re.S,
)
DIRECTIVE = re.compile(r"(?m)^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", re.S)

TYPE_WORDS = frozenset(
    "void char short int long float double signed unsigned _Bool bool _Complex size_t ssize_t intptr_t uintptr_t ptrdiff_t wchar_t off_t "
    "int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t".split()
)
QUALIFIERS = frozenset("const volatile restrict static extern register auto inline typedef _Thread_local _Atomic _Noreturn __restrict __inline __extension__ _Alignas".split())
TAGGED = frozenset(("struct", "union", "enum"))
STATEMENT_WORDS = frozenset("if else while do for switch case default return goto break continue".split())
ASSIGNS = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
BINARY = {op: level for level, ops in enumerate((("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))) for op in ops}
WRAPPERS = frozenset("parenthesized_expression cast_expression unary_expression binary_expression subscript_expression field_expression".split())
LOOPS = frozenset("if_statement while_statement do_statement for_statement".split())


@dataclass(slots=True, eq=False)
class Node:
    kind: str
    start: int
    end: int = 0
    children: list = field(default_factory=list)
    fields: dict = field(default_factory=dict)
    parent: object = None

    def add(self, child, name: str | None = None):
        if child is not None:
            child.parent = self
            self.children.append(child)
            if name:
                self.fields[name] = child
        return child


class Broken(Exception):
    pass


class Parser:
    def __init__(self, source: bytes):
        self.text = source.decode("latin-1")
        blanked = DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), self._without_comments(self.text))
        self.tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in TOKEN.finditer(blanked) if m.lastgroup not in ("blank", "comment")]
        n = len(self.text)
        self.tokens.append(("end", "", n, n))
        self.at = 0

    @staticmethod
    def _without_comments(text: str) -> str:
        return "".join(re.sub(r"[^\n]", " ", m.group()) if m.lastgroup == "comment" else m.group() for m in TOKEN.finditer(text))

    # tokens
    def peek(self, k: int = 0):
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def is_(self, *values: str) -> bool:
        t = self.peek()
        return t[1] in values and t[0] in ("op", "name")

    def take(self, value: str | None = None):
        t = self.peek()
        if value is not None and t[1] != value or t[0] == "end":
            raise Broken(value)
        self.at += 1
        return t

    def last_end(self) -> int:
        return self.tokens[self.at - 1][3] if self.at else 0

    def done(self, node: Node) -> Node:
        node.end = self.last_end()
        return node

    def skip(self, opening: str, closing: str) -> None:
        """Past a balanced group that starts here."""
        depth = 0
        while True:
            t = self.take()
            depth += (t[1] == opening) - (t[1] == closing)
            if depth <= 0:
                return

    # file and declarations
    def file(self) -> Node:
        root = Node("translation_unit", 0)
        while self.peek()[0] != "end":
            before = self.at
            try:
                root.add(self.external())
            except Broken:
                self.recover(before)
        return self.done(root)

    def recover(self, before: int) -> None:
        self.at = max(self.at, before)
        while self.peek()[0] != "end" and not self.is_(";", "}"):
            self.at += 1
        if self.peek()[0] != "end":
            self.at += 1
        elif self.at == before:
            self.at += 1

    def external(self) -> Node | None:
        if self.is_(";", "}"):
            self.take()
            return None
        if self.is_("extern") and self.peek(1)[0] == "string" and self.peek(2)[1] == "{":
            self.at += 3
            return None
        k, depth, assigned = 0, 0, False
        while True:
            kind, value, *_ = self.peek(k)
            if kind == "end" or value == ";" and not depth and kind == "op":
                break
            if kind == "op":
                if value == "{" and not depth:
                    if not assigned and k and (self.peek(k - 1)[1] == ")" or self.old_style(k)):
                        return self.function(k)
                    break
                assigned |= value == "=" and not depth
                depth += (value in "([") - (value in ")]")
            k += 1
        return self.declaration()

    def old_style(self, k: int) -> bool:
        """Parameters declared between the closing parenthesis and the body, or an attribute after it."""
        seen = [self.peek(i)[1] for i in range(k)]
        return ")" in seen and not any(w in TAGGED for w in seen[-2:]) and seen[0] not in TAGGED

    def function(self, brace: int) -> Node:
        node = Node("function_definition", self.peek()[2])
        self.at += brace
        node.add(self.block(), "body")
        return self.done(node)

    def starts_declaration(self) -> bool:
        kind, value, *_ = self.peek()
        if kind != "name" or value in STATEMENT_WORDS or value in ("sizeof",):
            return False
        if value in TYPE_WORDS or value in QUALIFIERS or value in TAGGED:
            return True
        k = 1
        if self.peek(1)[0] == "name":
            return self.peek(1)[1] not in STATEMENT_WORDS
        while self.peek(k)[1] == "*" or self.peek(k)[1] in QUALIFIERS:
            k += 1
        return k > 1 and self.peek(k)[0] == "name" and self.peek(k + 1)[1] in ("=", ";", ",", "[")

    def specifiers(self) -> None:
        typed = False
        while True:
            kind, value, *_ = self.peek()
            if kind != "name":
                return
            if value in TAGGED:
                self.take()
                if self.peek()[0] == "name":
                    self.take()
                if self.is_("{"):
                    self.skip("{", "}")
                typed = True
            elif value in ("__attribute__", "_Alignas", "typeof", "__typeof__"):
                self.take()
                if self.is_("("):
                    self.skip("(", ")")
                typed |= "typeof" in value
            elif value in TYPE_WORDS:
                self.take()
                typed = True
            elif value in QUALIFIERS:
                self.take()
            elif not typed and (self.peek(1)[0] == "name" or self.peek(1)[1] in ("*", "(")):
                self.take()
                typed = True
            else:
                return

    def declarator(self) -> Node | None:
        start = self.peek()[2]
        if self.is_("*"):
            self.take()
            while self.peek()[1] in QUALIFIERS:
                self.take()
            node = Node("pointer_declarator", start)
            node.add(self.declarator())
            return self.done(node)
        node = None
        if self.is_("("):
            node = Node("parenthesized_declarator", start)
            self.take()
            node.add(self.declarator())
            self.take(")")
            self.done(node)
        elif self.peek()[0] == "name":
            self.take()
            node = self.done(Node("identifier", start))
        while self.is_("[", "("):
            outer = Node("array_declarator" if self.is_("[") else "function_declarator", start)
            outer.add(node)
            self.skip(*("[]" if self.is_("[") else "()"))
            node = self.done(outer)
        return node

    def declaration(self) -> Node:
        node = Node("declaration", self.peek()[2])
        self.specifiers()
        while not self.is_(";"):
            start = self.peek()[2]
            named = self.declarator()
            if self.is_(":"):
                self.take()
                self.conditional()
            while self.is_("__attribute__", "asm", "__asm__"):
                self.take()
                self.skip("(", ")")
            if self.is_("="):
                self.take()
                init = Node("init_declarator", start)
                init.add(named, "declarator")
                init.add(self.initializer(), "value")
                node.add(self.done(init))
            elif named is not None:
                node.add(named)
            if self.is_(","):
                self.take()
            elif not self.is_(";"):
                raise Broken(";")
        self.take(";")
        return self.done(node)

    def initializer(self) -> Node:
        if not self.is_("{"):
            return self.assignment()
        node = Node("initializer_list", self.take()[2])
        while not self.is_("}"):
            if self.is_(".", "["):
                while not self.is_("="):
                    self.skip("[", "]") if self.is_("[") else self.take()
                self.take("=")
            node.add(self.initializer())
            if self.is_(","):
                self.take()
            elif not self.is_("}"):
                raise Broken("}")
        self.take("}")
        return self.done(node)

    # statements
    def block(self) -> Node:
        node = Node("compound_statement", self.take("{")[2])
        while not self.is_("}") and self.peek()[0] != "end":
            before = self.at
            try:
                node.add(self.statement())
            except Broken:
                self.at = max(self.at, before)
                while self.peek()[0] != "end" and not self.is_(";", "}"):
                    self.at += 1
                if self.is_(";"):
                    self.at += 1
        if self.is_("}"):
            self.take()
        return self.done(node)

    def condition(self) -> Node:
        node = Node("parenthesized_expression", self.take("(")[2])
        node.add(self.expression())
        self.take(")")
        return self.done(node)

    def statement(self) -> Node | None:
        kind, value, start, _ = self.peek()
        if value == "{":
            return self.block()
        if value == ";" and kind == "op":
            self.take()
            return self.done(Node("expression_statement", start))
        method = getattr(self, f"_{value}", None) if kind == "name" and value in STATEMENT_WORDS else None
        if method:
            return method(start)
        if kind == "name" and self.peek(1)[1] == ":" and value not in TYPE_WORDS:
            node = Node("labeled_statement", start)
            self.take()
            node.add(self.done(Node("statement_identifier", start)), "label")
            self.take(":")
            if not self.is_("}"):
                node.add(self.statement())
            return self.done(node)
        if self.starts_declaration():
            return self.declaration()
        node = Node("expression_statement", start)
        node.add(self.expression())
        self.take(";")
        return self.done(node)

    def _if(self, start):
        node = Node("if_statement", start)
        self.take()
        node.add(self.condition(), "condition")
        node.add(self.statement(), "consequence")
        if self.is_("else"):
            branch = Node("else_clause", self.take()[2])
            branch.add(self.statement())
            node.add(self.done(branch), "alternative")
        return self.done(node)

    def _while(self, start):
        node = Node("while_statement", start)
        self.take()
        node.add(self.condition(), "condition")
        node.add(self.statement(), "body")
        return self.done(node)

    def _switch(self, start):
        node = Node("switch_statement", start)
        self.take()
        node.add(self.condition(), "condition")
        node.add(self.statement(), "body")
        return self.done(node)

    def _do(self, start):
        node = Node("do_statement", start)
        self.take()
        node.add(self.statement(), "body")
        self.take("while")
        node.add(self.condition(), "condition")
        self.take(";")
        return self.done(node)

    def _for(self, start):
        node = Node("for_statement", start)
        self.take()
        self.take("(")
        if self.is_(";"):
            self.take()
        elif self.starts_declaration():
            node.add(self.declaration(), "initializer")
        else:
            node.add(self.expression(), "initializer")
            self.take(";")
        if not self.is_(";"):
            node.add(self.expression(), "condition")
        self.take(";")
        if not self.is_(")"):
            node.add(self.expression(), "update")
        self.take(")")
        node.add(self.statement(), "body")
        return self.done(node)

    def _case(self, start):
        node = Node("case_statement", start)
        if self.take()[1] == "case":
            node.add(self.conditional())
            if self.is_("..."):
                self.take()
                node.add(self.conditional())
        self.take(":")
        while not self.is_("case", "default", "}") and self.peek()[0] != "end":
            node.add(self.statement())
        return self.done(node)

    _default = _case

    def _return(self, start):
        node = Node("return_statement", start)
        self.take()
        if not self.is_(";"):
            node.add(self.expression())
        self.take(";")
        return self.done(node)

    def _goto(self, start):
        node = Node("goto_statement", start)
        self.take()
        if self.peek()[0] == "name":
            label = Node("statement_identifier", self.take()[2])
            node.add(self.done(label), "label")
        else:
            node.add(self.expression())
        self.take(";")
        return self.done(node)

    def _break(self, start):
        kind = f"{self.take()[1]}_statement"
        self.take(";")
        return self.done(Node(kind, start))

    _continue = _break

    # expressions
    def expression(self) -> Node:
        left = self.assignment()
        while self.is_(","):
            node = Node("comma_expression", left.start)
            node.add(left)
            self.take()
            node.add(self.assignment())
            left = self.done(node)
        return left

    def assignment(self) -> Node:
        left = self.conditional()
        if self.peek()[0] == "op" and self.peek()[1] in ASSIGNS:
            node = Node("assignment_expression", left.start)
            node.add(left, "left")
            self.take()
            node.add(self.initializer(), "right")
            return self.done(node)
        return left

    def conditional(self) -> Node:
        test = self.binary(0)
        if not self.is_("?"):
            return test
        node = Node("conditional_expression", test.start)
        node.add(test)
        self.take()
        if not self.is_(":"):
            node.add(self.expression())
        self.take(":")
        node.add(self.assignment())
        return self.done(node)

    def binary(self, level: int) -> Node:
        left = self.unary()
        while self.peek()[0] == "op" and (found := BINARY.get(self.peek()[1], -1)) >= level:
            node = Node("binary_expression", left.start)
            node.add(left)
            self.take()
            node.add(self.binary(found + 1))
            left = self.done(node)
        return left

    def cast_ahead(self) -> bool:
        """( type ) followed by an operand."""
        kind, value, *_ = self.peek(1)
        if kind != "name":
            return False
        k, typed = 1, False
        while True:
            kind, value, *_ = self.peek(k)
            if kind == "name":
                typed |= value in TYPE_WORDS or value in TAGGED or value in QUALIFIERS
                k += 1
            elif value == "*":
                k += 1
            elif value == "[" and self.peek(k + 1)[1] == "]":
                k += 2
            elif value == "(" and self.peek(k + 1)[1] == "*" and self.peek(k + 2)[1] == ")" and self.peek(k + 3)[1] == "(":
                k += 3
                while self.peek(k)[1] != ")" and self.peek(k)[0] != "end":
                    k += 1
                k += 1
            else:
                break
        if value != ")":
            return False
        starred = self.peek(k - 1)[1] == "*"
        kind, value, *_ = self.peek(k + 1)
        if typed or starred:
            return kind in ("name", "number", "string", "char") or value in ("(", "*", "&", "-", "+", "!", "~", "++", "--", "{")
        return k == 2 and (kind in ("name", "number", "string", "char"))

    def type_descriptor(self) -> Node:
        node = Node("type_descriptor", self.peek()[2])
        depth = 0
        while depth or not self.is_(")"):
            t = self.take()
            depth += (t[1] == "(") - (t[1] == ")")
        return self.done(node)

    def unary(self) -> Node:
        kind, value, start, _ = self.peek()
        if kind == "op" and value in ("!", "~", "-", "+", "*", "&", "++", "--"):
            node = Node({"*": "pointer_expression", "&": "pointer_expression", "++": "update_expression", "--": "update_expression"}.get(value, "unary_expression"), start)
            self.take()
            node.add(self.unary())
            return self.done(node)
        if kind == "name" and value in ("sizeof", "_Alignof", "alignof", "__alignof__"):
            node = Node("sizeof_expression", start)
            self.take()
            if self.is_("(") and self.type_in_parentheses():
                self.take()
                node.add(self.type_descriptor(), "type")
                self.take(")")
            else:
                node.add(self.unary())
            return self.done(node)
        if value == "(" and kind == "op" and self.cast_ahead():
            self.take()
            described = self.type_descriptor()
            self.take(")")
            if self.is_("{"):
                node = Node("compound_literal_expression", start)
                node.add(described)
                node.add(self.initializer())
                return self.postfix(self.done(node))
            node = Node("cast_expression", start)
            node.add(described, "type")
            node.add(self.unary(), "value")
            return self.done(node)
        return self.postfix(self.primary())

    def type_in_parentheses(self) -> bool:
        kind, value, *_ = self.peek(1)
        return kind == "name" and (value in TYPE_WORDS or value in QUALIFIERS or value in TAGGED)

    def primary(self) -> Node:
        kind, value, start, _ = self.take()
        if kind == "name":
            if value in STATEMENT_WORDS:
                raise Broken(value)
            return self.done(Node("identifier", start))
        if kind == "string":
            one = self.done(Node("string_literal", start))
            if self.peek()[0] != "string" and not (self.peek()[0] == "name" and self.peek(1)[0] == "string"):
                return one
            node = Node("concatenated_string", start)
            node.add(one)
            while self.peek()[0] in ("string", "name"):
                t = self.take()
                node.add(self.done(Node("string_literal" if t[0] == "string" else "identifier", t[2])))
            return self.done(node)
        if kind in ("number", "char"):
            return self.done(Node(f"{kind}_literal", start))
        if value == "(":
            node = Node("parenthesized_expression", start)
            node.add(self.block() if self.is_("{") else self.expression())
            self.take(")")
            return self.done(node)
        raise Broken(value)

    def postfix(self, left: Node) -> Node:
        while True:
            kind, value, *_ = self.peek()
            if kind != "op":
                return left
            if value == "(":
                node = Node("call_expression", left.start)
                node.add(left, "function")
                args = Node("argument_list", self.take()[2])
                while not self.is_(")"):
                    args.add(self.argument())
                    if self.is_(","):
                        self.take()
                    elif not self.is_(")"):
                        raise Broken(")")
                self.take(")")
                node.add(self.done(args), "arguments")
            elif value == "[":
                node = Node("subscript_expression", left.start)
                node.add(left)
                self.take()
                node.add(self.expression())
                self.take("]")
            elif value in (".", "->"):
                node = Node("field_expression", left.start)
                node.add(left)
                self.take()
                node.add(self.done(Node("field_identifier", self.take()[2])))
            elif value in ("++", "--"):
                node = Node("update_expression", left.start)
                node.add(left)
                self.take()
            else:
                return left
            left = self.done(node)

    def argument(self) -> Node:
        """An expression, or a type as in va_arg(ap, int)."""
        if self.peek()[0] == "name" and (self.peek()[1] in TYPE_WORDS or self.peek()[1] in TAGGED):
            node = Node("type_descriptor", self.peek()[2])
            while not self.is_(",", ")"):
                self.take()
            return self.done(node)
        return self.assignment()


# What the rules need to know of a tree.

EXITS = frozenset(("exit", "_exit", "_Exit", "abort"))
ENVIRONMENT = frozenset(("getenv", "secure_getenv", "putenv", "setenv", "unsetenv", "clearenv"))
ALLOCATORS = frozenset(("malloc", "calloc"))
CLOSERS = frozenset(("close", "fclose", "pclose", "free", "munmap"))


def ascended(node: Node) -> Node:
    while node.parent is not None and node.parent.kind in WRAPPERS:
        node = node.parent
    return node


class Facts:
    """Events of one file, as plain dictionaries; positions are 1-based."""

    def __init__(self, source: str, line_map: list[int] | None = None):
        self.parser = Parser(source.encode("utf-8", "surrogateescape"))
        self.text = self.parser.text
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]
        self.line_map = line_map
        self.events: list[dict] = []
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        try:
            self.root = self.parser.file()
        except RecursionError:
            self.root = Node("translation_unit", 0)

    def source(self, node: Node) -> str:
        return self.text[node.start : node.end].encode("latin-1").decode("utf-8", "replace")

    def place(self, node: Node) -> dict:
        row = bisect_right(self.starts, node.start) - 1
        line = self.line_map[row] if self.line_map is not None and row < len(self.line_map) else row + 1
        return {"line": line, "column": node.start - self.starts[row] + 1}

    def callee(self, node: Node) -> str | None:
        f = node.fields["function"]
        return self.source(f) if f.kind == "identifier" else None

    def collect(self) -> list[dict]:
        stack, n = [self.root], 0
        while stack:
            node = stack.pop()
            if node.kind == "call_expression" and (name := self.callee(node)) is not None:
                n += 1
                self.events.append({"kind": "call", "seq": n, "function": name, **self.place(node), **self.usage(node)})
            stack.extend(reversed(node.children))
        clock = 0
        for number, function in enumerate(c for c in self.root.children if c.kind == "function_definition"):
            stack = [function.fields["body"]]
            while stack:
                node = stack.pop()
                clock += 1
                if isinstance(node, tuple):  # an assignment all of whose parts have been seen
                    self.events.append({"kind": "clear", "seq": clock, "func_id": number, "var": node[0]})
                    continue
                stack_children = list(reversed(node.children))
                if node.kind == "call_expression":
                    self.resource(node, clock, number, function)
                elif node.kind == "assignment_expression" and node.fields["left"].kind == "identifier":
                    stack.append((self.source(node.fields["left"]),))
                elif node.kind == "declaration":
                    self.allocations(node, clock, number)
                stack.extend(stack_children)
        return self.events

    def usage(self, call: Node) -> dict:
        """How a call's value is used: facts only, the verdict is an expression on them."""
        e = ascended(call)
        p = e.parent
        out = {
            "e_kind": e.kind, "p_kind": p.kind if p is not None else None,
            "void_cast": e.kind == "cast_expression" and "void" in self.source(e.fields["type"])[:15],
            "in_condition": self.in_condition(e), "arg_kinds": [a.kind for a in call.fields["arguments"].children],
        }
        var, block = self.stored_in(e, p), self.block_statement(call)
        later = var is not None and block is not None and self.checked_later(block, var)
        return out | {"store_var": var, "in_block": block is not None, "checked_later": later}

    @staticmethod
    def in_condition(node: Node) -> bool:
        while node.parent is not None:
            if node.parent.kind in LOOPS and node.parent.fields.get("condition") is node:
                return True
            node = node.parent
        return False

    def stored_in(self, e: Node, p: Node | None) -> str | None:
        holder = next((x for x in (e, p) if x is not None and x.kind == "init_declarator"), None)
        if holder is not None:
            target = holder.fields.get("declarator")
            if target is not None and target.kind == "pointer_declarator":
                target = next((c for c in target.children if c.kind == "identifier"), None)
        else:
            holder = next((x for x in (e, p) if x is not None and x.kind == "assignment_expression"), None)
            target = holder.fields["left"] if holder is not None else None
        return self.source(target)[:63] if target is not None and target.kind == "identifier" else None

    @staticmethod
    def block_statement(node: Node) -> Node | None:
        while node.parent is not None:
            if node.parent.kind == "compound_statement":
                return node
            node = node.parent
        return None

    def mentions(self, node: Node | None, name: str) -> bool:
        return node is not None and re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", self.source(node)) is not None

    def checked_later(self, statement: Node, name: str) -> bool:
        siblings = statement.parent.children
        for node in siblings[siblings.index(statement) + 1 :]:
            if node.kind in LOOPS or node.kind == "switch_statement":
                if self.mentions(node.fields.get("condition"), name):
                    return True
            elif node.kind == "return_statement":
                if self.mentions(node, name):
                    return True
            elif node.kind == "expression_statement" and node.children:
                inner = node.children[0]
                if inner.kind == "cast_expression" and self.mentions(inner, name):
                    return True
                if inner.kind == "call_expression" and (self.callee(inner) or "").startswith("check_"):
                    if any(a.kind == "identifier" and self.source(a) == name for a in inner.fields["arguments"].children):
                        return True
        return False

    def resource(self, call: Node, clock: int, number: int, function: Node) -> None:
        f = call.fields["function"]
        args = call.fields["arguments"].children
        if f.kind == "identifier" and (api := self.source(f)) in CLOSERS and args:
            arg = args[0]
            if arg.kind == "unary_expression" and arg.children and arg.children[0].kind == "identifier":
                arg = arg.children[0]
            if arg.kind == "identifier":
                self.events.append({"kind": "close", "seq": clock, "func_id": number, "function": api, "var": self.source(arg)[:63], "terminal": self.is_terminal(call, function), **self.place(call)})
        name = self.source(f)
        if name in ENVIRONMENT:
            literal = self.source(args[0])[1:].removesuffix('"') if args and args[0].kind == "string_literal" else None
            self.events.append({"kind": "env", "seq": clock, "func_id": number, "function": name, "var": literal, **self.place(call)})

    def allocations(self, declaration: Node, clock: int, number: int) -> None:
        for init in declaration.children:
            if init.kind != "init_declarator" or init.fields["value"].kind != "call_expression":
                continue
            value, names = init.fields["value"], []
            todo = [init.fields.get("declarator")]
            while todo:
                node = todo.pop()
                if node is not None:
                    if node.kind == "identifier":
                        names.append(self.source(node))
                    todo += reversed(node.children)
            if self.source(value.fields["function"]) in ALLOCATORS and names:
                said = self.text[value.start : value.end][:255]
                if f"sizeof({names[0]})" in said or f"sizeof ({names[0]})" in said:
                    self.events.append({"kind": "alloc", "seq": clock, "func_id": number, "var": names[0][:63], **self.place(value)})

    def leaves(self, node: Node) -> bool:
        return node.kind == "return_statement" or node.kind == "expression_statement" and any(c.kind == "call_expression" and self.callee(c) in EXITS for c in node.children)

    def is_terminal(self, call: Node, function: Node) -> bool:
        """Whether the block of the call's statement goes on to a return, an exit, or a jump to a label that is one."""
        node = call
        while node is not None and node.kind != "expression_statement":
            node = node.parent
        if node is None:
            return False
        siblings = node.parent.children
        for later in siblings[siblings.index(node) + 1 :]:
            if self.leaves(later):
                return True
            if later.kind == "goto_statement" and (label := later.fields.get("label")) is not None and self.label_leaves(function, self.source(label)):
                return True
        return False

    def label_leaves(self, function: Node, name: str) -> bool:
        stack = [function.fields["body"]]
        while stack:
            node = stack.pop()
            if node.kind == "labeled_statement" and self.source(node.fields["label"]) == name:
                return len(node.children) > 1 and self.leaves(node.children[1])
            stack.extend(reversed(node.children))
        return False


def c_events(source: str, line_map: list[int] | None = None) -> list[dict]:
    """All events of one source text: call, close, clear, env, alloc."""
    return Facts(source, line_map).collect()
