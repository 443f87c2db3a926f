"""The open elements of a page under way, shared by both HTML passes."""

from collections import Counter

#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class OpenElements:
    """A stack with a count for each tag, so that no start, end or text of a page walks it."""

    def __init__(self):
        self.stack: list[str] = []
        self.count: Counter = Counter()

    def __len__(self) -> int:
        return len(self.stack)

    def __contains__(self, tag: str) -> bool:
        return self.count[tag] > 0

    def last(self) -> str:
        return self.stack[-1] if self.stack else ""

    def begin(self, tag: str) -> None:
        self.stack.append(tag)
        self.count[tag] += 1

    def end(self, tag: str):
        """The elements that an end tag closes, innermost first; none if no such element is open. Each is closed as it is taken."""
        while tag in self:
            last = self.stack.pop()
            self.count[last] -= 1
            yield last
            if last == tag:
                return
