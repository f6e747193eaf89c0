"""Grammars of this package: JSON, INI, block configuration, expressions, HTML, prose lines and a shell subset."""

from __future__ import annotations

from functools import lru_cache

from .dsl import Grammar, Ladder, alias, choice, field, immediate_token, opt, pattern, prec, prec_left, prec_right, ref, repeat, seq, token


def json_grammar() -> Grammar:
    g = Grammar("json", start="document")
    comma = lambda item: opt(seq(item, repeat(seq(",", item))))
    content = immediate_token(prec(1, pattern(r'(?:[^"\\\n]|\\.)+')))
    g.rule("document", repeat(ref("_value")))
    g.rule("_value", choice(*map(ref, ("object", "array", "number", "string", "true", "false", "null"))), supertype=True)
    g.rule("object", seq("{", comma(ref("pair")), "}"))
    g.rule("pair", seq(field("key", choice(ref("string"), ref("number"))), ":", field("value", ref("_value"))))
    g.rule("array", seq("[", comma(ref("_value")), "]"))
    g.rule("string", seq('"', opt(ref("string_content")), immediate_token('"')))
    g.rule("string_content", content)
    g.rule("number", pattern(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"))
    for name in ("true", "false", "null"):
        g.rule(name, name)
    return g


def ini_grammar() -> Grammar:
    g = Grammar("ini", default_whitespace=False, start="source_file")
    g.extra(pattern(r"[ \t\r]"), ref("comment"))
    g.rule("source_file", repeat(choice(ref("section"), ref("directive"), ref("_newline"))))
    g.rule("section", prec_right(0, seq("[", field("name", ref("section_name")), "]", ref("_newline"), repeat(choice(ref("entry"), ref("note"), ref("_newline"))))))
    g.rule("section_name", pattern(r"[A-Za-z0-9_.-]+"))
    g.rule("entry", seq(field("key", ref("identifier")), "=", field("value", ref("_scalar")), ref("_newline")))
    g.rule("note", seq(field("key", ref("identifier")), ":", field("value", ref("_scalar")), ref("_newline")))
    g.rule("directive", seq("@", field("name", ref("identifier")), field("value", ref("_scalar")), ref("_newline")))
    g.rule("_scalar", choice(ref("integer"), ref("boolean"), ref("string"), ref("bare")), supertype=True)
    g.rule("integer", pattern(r"-?[0-9]+(?=[ \t\r]*(?:\n|$|;))"))
    g.rule("boolean", choice("true", "false"))
    g.rule("string", seq('"', opt(ref("string_content")), immediate_token('"')))
    g.rule("string_content", immediate_token(prec(1, pattern(r'(?:[^"\\\n]|\\.)+'))))
    g.rule("bare", token(prec(-1, pattern(r'[^\s"\[\]=;@:][^\n;]*[^\s;]|[^\s"\[\]=;@:]'))))
    g.rule("identifier", pattern(r"[A-Za-z_][A-Za-z0-9_-]*"), word=True)
    g.rule("comment", pattern(r";[^\n]*"))
    g.rule("_newline", pattern(r"\n"))
    return g


def conf_grammar() -> Grammar:
    """Blocks of bindings: ``name = { key = value; };``."""
    g = Grammar("conf", start="source_file")
    g.extra(pattern(r"\s"), ref("comment"))
    g.rule("source_file", repeat(ref("binding")))
    g.rule("binding", seq(field("path", ref("path")), "=", field("value", ref("_value")), ";"))
    g.rule("path", seq(ref("identifier"), repeat(seq(".", ref("identifier")))))
    g.rule("_value", choice(ref("block"), ref("list"), ref("string"), ref("integer"), ref("boolean")), supertype=True)
    g.rule("block", seq("{", repeat(ref("binding")), "}"))
    g.rule("list", seq("[", repeat(ref("_value")), "]"))
    g.rule("string", seq('"', opt(ref("string_content")), immediate_token('"')))
    g.rule("string_content", immediate_token(prec(1, pattern(r'(?:[^"\\]|\\.)+'))))
    g.rule("integer", pattern(r"-?[0-9]+"))
    g.rule("boolean", choice("true", "false"))
    g.rule("identifier", pattern(r"[A-Za-z_][A-Za-z0-9_-]*"), word=True)
    g.rule("comment", pattern(r"#[^\n]*"))
    return g


def expr_grammar() -> Grammar:
    """Assignments and expressions with the usual levels."""
    from .expressions import expression

    g = Grammar("expr", start="source_file")
    g.rule("source_file", repeat(ref("_statement")))
    g.rule("_statement", choice(ref("assignment"), ref("expression_statement")), supertype=True)
    g.rule("assignment", seq(field("left", ref("identifier")), "=", field("right", ref("expression")), ";"))
    g.rule("expression_statement", seq(ref("expression"), ";"))
    g.rule("identifier", pattern(r"[A-Za-z_][A-Za-z0-9_]*"), word=True)
    g.rule("number", pattern(r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"))
    g.rule("parenthesized", seq("(", ref("expression"), ")"))
    ladder = Ladder("or", "and", "compare", "sum", "product", "unary", "power", "call")
    expression(
        g, "expression", primary=("number", "identifier", "parenthesized"), ladder=ladder,
        infix={"or": ("or",), "and": ("and",), "compare": ("==", "<", ">"), "sum": ("+", "-"), "product": ("*", "/")},
        right={"power": ("^",)}, prefix={"unary": ("-", "not")},
        postfix={"call": ("call", lambda e: seq(field("function", e), "(", opt(seq(field("argument", e), repeat(seq(",", field("argument", e))))), ")"))},
    )
    return g


def html_grammar() -> Grammar:
    """Tags as they stand in a text; elements are not paired, so unclosed ones do no harm."""
    g = Grammar("html", default_whitespace=False, start="document")
    g.rule("document", repeat(ref("_item")))
    g.rule("_item", choice(*map(ref, ("doctype", "comment", "script", "element_start", "link", "heading", "title", "element_end", "text", "entity", "stray"))))
    g.rule("doctype", token(prec(2, pattern(r"<![A-Za-z][^>]*>"))))
    g.rule("comment", token(prec(2, pattern(r"<!--(?:[^-]|-(?!->))*-->"))))
    blanks = pattern(r"[ \t\r\n]+")
    attributes = repeat(seq(blanks, opt(ref("attribute"))))
    close = choice(">", "/>")
    raw = lambda name: seq(token(prec(2, pattern(rf"<(?i:{name})(?=[\s>/])"))), attributes, ">", opt(field("body", ref("raw_text"))), token(prec(2, pattern(rf"</(?i:{name})\s*>"))))
    g.rule("script", choice(raw("script"), raw("style")))
    g.rule("raw_text", token(prec(1, pattern(r"(?:[^<]|<(?!/(?i:script|style)))+"))))
    tag = lambda name: token(prec(2, pattern(rf"<(?i:{name})(?=[\s>/])")))
    g.rule("link", prec_right(1, seq(tag("a"), attributes, close, opt(field("content", ref("text"))))))
    g.rule("heading", prec_right(1, seq(field("level", alias(token(prec(2, pattern(r"<[hH][1-6](?=[\s>/])"))), "level")), attributes, close, opt(field("content", ref("inner_text"))))))
    g.rule("title", prec_right(1, seq(tag("title"), attributes, close, opt(field("content", ref("inner_text"))))))
    g.rule("element_start", seq(token(prec(1, "<")), field("name", ref("tag_name")), attributes, close))
    g.rule("element_end", seq(token(prec(1, "</")), field("name", ref("tag_name")), opt(blanks), ">"))
    g.rule("tag_name", immediate_token(pattern(r"[A-Za-z][A-Za-z0-9:-]*")))
    g.rule("attribute", seq(field("key", ref("attribute_name")), opt(seq(pattern(r"\s*=\s*"), field("value", ref("_attribute_value"))))))
    g.rule("attribute_name", pattern(r"[^\s\"'<>/=]+"))
    g.rule("_attribute_value", choice(ref("quoted_value"), ref("bare_value")))
    g.rule("quoted_value", choice(seq('"', opt(ref("value_content")), token('"')), seq("'", opt(alias(ref("single_content"), "value_content")), token("'"))))
    g.rule("value_content", token(prec(1, pattern(r'[^"]+'))))
    g.rule("single_content", token(prec(1, pattern(r"[^']+"))))
    g.rule("bare_value", pattern(r"[^\s\"'<>=`]+"))
    # Titles and headings keep their entities.
    g.rule("inner_text", token(prec(1, pattern(r"[^<]+"))))
    g.rule("entity", pattern(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"))
    g.rule("text", pattern(r"[^<&]+"))
    g.rule("stray", token(prec(-5, pattern(r"[<&]"))))
    return g


def lines_grammar() -> Grammar:
    """One node for each line that is not empty."""
    g = Grammar("lines", default_whitespace=False, start="document")
    g.rule("document", repeat(choice(ref("line"), "\n")))
    g.rule("line", field("content", ref("content")))
    g.rule("content", pattern(r"[^\n]+"))
    return g


def tokens_grammar() -> Grammar:
    g = Grammar("tokens", start="document")
    g.rule("document", repeat(choice(ref("email"), ref("number"), ref("word"), ref("mark"))))
    g.rule("email", token(prec(3, pattern(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"))))
    g.rule("number", token(prec(2, pattern(r"[0-9]+(?![^\W_])"))))
    g.rule("word", token(prec(1, pattern(r"[^\W_]+"))))
    g.rule("mark", pattern(r"[\W_]"))
    return g


def shell_grammar() -> Grammar:
    """Functions, assignments, commands and heredocs of shell scripts."""
    g = Grammar("shell", default_whitespace=False, start="program")
    g.extra(pattern(r"[ \t]"), ref("comment"))
    g.external("heredoc_start", "heredoc_body")
    g.rule("program", repeat(choice(ref("_statement"), ref("_end"))))
    g.rule("_statement", choice(ref("function_definition"), ref("variable_assignment"), ref("command")))
    g.rule("function_definition", seq(opt("function"), field("name", ref("word")), "(", ")", field("body", ref("group"))))
    g.rule("group", seq("{", repeat(choice(ref("_statement"), ref("_end"))), "}"))
    g.rule("variable_assignment", prec_right(0, seq(field("name", ref("variable_name")), opt(field("value", ref("_value"))))))
    g.rule("variable_name", token(prec(2, pattern(r"[A-Za-z_][A-Za-z0-9_]*="))))
    g.rule("_value", choice(ref("word"), ref("string"), ref("raw_string")))
    g.rule("command", prec_left(0, seq(field("name", ref("word")), repeat(choice(field("argument", ref("_value")), ref("redirect"))))))
    g.rule("redirect", choice(ref("heredoc"), seq(choice(">", ">>", "<"), ref("word"))))
    g.rule("heredoc", seq("<<", field("start", ref("heredoc_start")), field("body", ref("heredoc_body"))))
    g.rule("string", seq('"', opt(ref("string_content")), immediate_token('"')))
    g.rule("string_content", immediate_token(prec(1, pattern(r'(?:[^"\\]|\\.)+'))))
    g.rule("raw_string", pattern(r"'[^']*'"))
    g.rule("word", pattern(r"[^\s\"'(){}<>;&|#=]+"))
    g.rule("comment", pattern(r"#[^\n]*"))
    g.rule("_end", pattern(r"[\n;]+"))
    return g


BUILDERS = {
    "json": json_grammar, "ini": ini_grammar, "conf": conf_grammar, "expr": expr_grammar, "html": html_grammar,
    "lines": lines_grammar, "tokens": tokens_grammar, "shell": shell_grammar,
}
#: Scanners that a grammar of this package needs.
SCANNERS = {"shell": "bash_heredoc"}


@lru_cache
def grammar(name: str):
    """A grammar of this package by name."""
    return BUILDERS[name]().build()


