"""Plain versions that tests compare with."""

import re


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(pattern, low)
