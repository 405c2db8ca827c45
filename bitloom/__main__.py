"""python -m bitloom validate FILE | types FILE | spark-type FILE TYPE | decode FILE TYPE HEX | describe FILE"""

from __future__ import annotations

import json
import sys

from .errors import SchemaError
from .schema.model import load


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("validate", "types", "spark-type", "decode", "describe"):
        print(__doc__)
        return 2
    try:
        with open(args[1], encoding="utf-8") as f:
            schema = load(f.read())
    except SchemaError as e:
        print("\n".join(e.problems))
        return 1
    if args[0] == "validate":
        print(f"{len(schema.types)} types, no problem")
    elif args[0] == "types":
        print("\n".join(sorted(schema.types)))
    elif args[0] == "spark-type":
        from .operators.types import spark_type

        print(spark_type(schema, args[2]).simpleString())
    elif args[0] == "decode":
        from .operators.decode_local import Decoder

        print(json.dumps(Decoder(schema, args[2]).decode(bytes.fromhex(args[3])), default=lambda x: list(x), ensure_ascii=False))
    else:
        from .schema.describe import markdown

        print(markdown(schema))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
