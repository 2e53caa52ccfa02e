"""Tools: python -m tessera json2json|minify|pretty|fractured|tape|pointer|stats FILE [POINTER...]"""

from __future__ import annotations

import json
import sys
from collections import Counter

from .functions import paths, write
from .functions.errors import JsonError, message
from .functions.tree import Tree, decode, first_pass, parse


def stats(tree: Tree) -> dict[str, int]:
    """The counters of one document."""
    kinds = Counter(n.kind for n in tree.nodes)
    keys = [n.key for n in tree.nodes if n.key is not None]
    strings = [n.value for n in tree.nodes if n.kind == "string"]
    size = lambda s: len(s.encode("utf-8", "surrogatepass"))
    return {
        "integer_count": kinds["int64"] + kinds["uint64"], "float_count": kinds["double"], "string_count": len(strings) + len(keys), "string_byte_count": sum(map(size, strings)) + sum(map(size, keys)),
        "backslash_count": tree.text.count("\\"), "non_ascii_byte_count": sum(b > 127 for b in tree.text.encode("utf-8", "surrogatepass")), "object_count": kinds["object"], "array_count": kinds["array"],
        "null_count": kinds["null"], "true_count": sum(n.value is True for n in tree.nodes), "false_count": sum(n.value is False for n in tree.nodes), "byte_count": size(tree.text), "key_count": len(keys),
        "key_maximum_length": max(map(size, keys), default=0), "maximum_depth": max(n.depth for n in tree.nodes), "maximum_object_size": max((n.children for n in tree.nodes if n.kind == "object"), default=0),
        "maximum_array_size": max((n.children for n in tree.nodes if n.kind == "array"), default=0), "repeated_key_count": len(keys) - len(set(keys)),
    }


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("json2json", "minify", "pretty", "fractured", "tape", "pointer", "stats"):
        print(__doc__, file=sys.stderr)
        return 2
    try:
        with open(args[1], "rb") as f:
            data = f.read()
    except OSError as e:
        print(f"IO_ERROR: {e}", file=sys.stderr)
        return 1
    try:
        if args[0] == "minify":
            text, good = decode(data)
            first_pass(text, utf8=good)
            print(write.strip_blanks(text))
            return 0
        tree = parse(data, big=True)
        if args[0] == "pointer":
            out = []
            for p in args[2:]:
                try:
                    out.append({"jsonpath": p, "value": json.loads(write.minify(tree, paths.at_pointer(tree, p)))})
                except JsonError as e:
                    out.append({"jsonpath": p, "error": message(e.code)})
            print(json.dumps(out, ensure_ascii=False))
        elif args[0] == "stats":
            print(json.dumps(stats(tree)))
        elif args[0] == "tape":
            print("\n".join(f"{i} : {w}" for i, w in enumerate(write.tape(tree))))
        else:
            print({"json2json": write.minify, "pretty": write.prettify, "fractured": write.fractured}[args[0]](tree))
    except JsonError as e:
        print(f"{e}" + ("" if e.at is None else f" (at {e.at})"), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
