"""Signatures: what Python annotations and Java declarations say about the values of a call."""

from __future__ import annotations

import ast
import re

SEQUENCES, NODES = {"List", "list", "Sequence", "Tuple", "tuple"}, {"ListNode": "list_node", "TreeNode": "tree_node"}
CPP_NAMES = {"float": "double", "double": "double", "str": "std::string", "String": "std::string", "bool": "bool", "char": "char", "ListNode": "ListNode*", "TreeNode": "TreeNode*"}
JAVA_WIDE = {"int": "long", "Integer": "Long"}


def hints(python: str | None, entry_point: str | None) -> tuple[list[str], str]:
    """The annotations of the entry point's parameters and of its result; '' where there is none. A source that
    doesn't parse or doesn't define it has none."""
    name = (entry_point or "solve").rsplit(".", 1)[-1]
    name = "solve" if name in ("", "None") else name
    try:
        found = [n for n in ast.walk(ast.parse(python or "")) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == name]
    except (SyntaxError, ValueError):
        return [], ""
    if not found:
        return [], ""
    said = lambda a: ast.unparse(a) if a else ""
    args = found[0].args
    return [said(a.annotation) for a in [*args.posonlyargs, *args.args, *args.kwonlyargs] if a.arg != "self"], said(found[0].returns)


def annotation(hint: str) -> ast.expr | None:
    """The annotation's expression, quoted or not."""
    try:
        node = ast.parse((hint or "").strip(), mode="eval").body
    except (SyntaxError, ValueError):
        return None
    return annotation(node.value) if isinstance(node, ast.Constant) and isinstance(node.value, str) else node


def name_of(node: ast.expr | None) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else annotation_name(node)


def annotation_name(node: ast.expr | None) -> str:
    return name_of(annotation(node.value)) if isinstance(node, ast.Constant) and isinstance(node.value, str) else ""


def without_none(node: ast.expr | None) -> ast.expr | None:
    """Optional[X], X | None and None | X are X."""
    nothing = lambda x: isinstance(x, ast.Constant) and x.value is None
    if isinstance(node, ast.Subscript) and name_of(node.value) == "Optional":
        return without_none(node.slice)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr) and (nothing(node.left) or nothing(node.right)):
        return without_none(node.left if nothing(node.right) else node.right)
    return node


def element(node: ast.expr | None) -> ast.expr | None:
    """What a sequence of one kind of element holds; None if it is no such sequence."""
    return node.slice if isinstance(node, ast.Subscript) and name_of(node.value) in SEQUENCES and not isinstance(node.slice, ast.Tuple) else None


def kind_of(hint: str) -> str:
    """Whether a value is a linked list, a tree (or a sequence of either), or plain."""
    node = without_none(annotation(hint))
    while (inner := element(node)) is not None:
        node = without_none(inner)
    return NODES.get(name_of(node), "plain")


def cpp_type(hint: str, value=None, far: bool = False, of_value=None) -> str:
    """C4: the C++ type of an annotation. far: some value there needs 64 bits. What isn't known by its name has the type
    of_value gives to the value, and without a value int."""

    def typed(node, value) -> str:
        node = without_none(node)
        if (inner := element(node)) is not None:
            return f"std::vector<{typed(inner, value[0] if isinstance(value, list) and value else None)}>"
        name = name_of(node)
        if name == "int":
            return "long long" if far or (type(value) is int and not -(2**31) <= value < 2**31) else "int"
        return CPP_NAMES.get(name) or (of_value(value) if of_value and value is not None else "int")

    return typed(annotation(hint), value)


def java_parameters(source: str | None, name: str) -> list[str] | None:
    """The types of a Java method's parameters; None if there is no such method."""
    if not source or not name or not (m := re.search(rf"\b{re.escape(name)}\s*\(", source)):
        return None
    depth, parts = 0, [""]
    for c in source[m.end() :]:
        if c == ")" and not depth:
            break
        depth += (c in "<([") - (c in ">)]")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    out = []
    for p in parts:
        words = re.sub(r"@\w+|\bfinal\b", " ", p).replace("...", "[]").split()
        if len(words) > 1:
            out.append("".join(words[:-1]) if len(words) > 2 and words[-2].startswith("[") else " ".join(words[:-1]).replace(" ", ""))
    return out or ([] if not parts[0].strip() else None)


def widened(java: str) -> str:
    """The Java type with 64-bit integers: of a scalar, its arrays, and lists of it."""
    return re.sub(r"^((?:List<)*)(int|Integer)((?:\[\])*|>*)$", lambda m: m[1] + JAVA_WIDE[m[2]] + m[3], java.strip())


def java_class(source: str | None) -> str:
    """C11: the name of the public class, else of the first one, else Main."""
    for form in (r"\bpublic\s+(?:(?:final|abstract|strictfp)\s+)*class\s+(\w+)", r"\bclass\s+(\w+)"):
        if m := re.search(form, source or ""):
            return m[1]
    return "Main"
