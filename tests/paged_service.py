"""A paged service of items kept in a file, for tests: every request is written down, and some fail as told."""

import json
import os

SIZE = 3


class Refused(Exception):
    def __init__(self, status, retry_after=None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def _asked(options):
    with open(f"{options['folder']}/items.json") as f:
        items = json.load(f)
    after, until, kind = options.get("updatedAfter"), options.get("updatedUntil"), options.get("type")
    return sorted((i for i in items if (after is None or i["updatedAt"] > after) and (until is None or i["updatedAt"] <= until) and (kind is None or i["type"] == kind)), key=lambda i: (i["updatedAt"], i["id"]))


def fetch(page, options):
    log = f"{options['folder']}/requests"
    with open(log, "a") as f:
        f.write(f"{page} {options.get('updatedAfter')} {options.get('type')}\n")
    failing = f"{options['folder']}/fail-{page}"
    if os.path.exists(failing):  # holds a status and how many times more
        with open(failing) as f:
            status, left = map(int, f.read().split())
        if left:
            with open(failing, "w") as f:
                f.write(f"{status} {left - 1}")
            raise Refused(status, 0.0)
    items = _asked(options)
    return [json.dumps(i) for i in items[SIZE * (page - 1) : SIZE * page]], page + 1 if len(items) > SIZE * page else None


def head(options):
    items = _asked(options)
    return (items[-1]["updatedAt"] if items else None), -(-len(items) // SIZE)
