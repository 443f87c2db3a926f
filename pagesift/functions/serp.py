"""Hits and hidden form fields of a search engine's result page, in one pass over its HTML."""

from html.parser import HTMLParser

from pagesift.constants import RESULT_SHAPES
from pagesift.functions.elements import VOID, OpenElements


class _Results(HTMLParser):
    def __init__(self, shape=None):
        super().__init__(convert_charrefs=True)
        self.shape, self.found, self.forms = shape, [], []
        self.hit_depth, self.hit, self.into = None, None, []
        self.open = OpenElements()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        names = a.get("class", "").split()
        if tag == "form":
            self.forms.append({})
        elif tag == "input" and self.forms and a.get("type", "").lower() == "hidden" and a.get("name"):
            self.forms[-1][a["name"]] = a.get("value", "")
        if tag not in VOID:
            self.open.begin(tag)
        if not self.shape:
            return
        container, title, link, snippet = self.shape
        if self.hit is None and tag == "div" and container in names:
            self.hit, self.hit_depth = {"title": None, "url": None, "snippet": None}, len(self.open)
            return
        if self.hit is None:
            return
        is_it = lambda want: tag == want[0] and (want[1] is None or any(n in names for n in want[1]))
        if is_it(link) and self.hit["url"] is None and "href" in a:
            self.hit["url"] = a["href"]
        for key, want in (("title", title), ("snippet", snippet)):
            if is_it(want) and self.hit[key] is None:
                self.hit[key] = []
                self.into.append((key, len(self.open)))

    def handle_endtag(self, tag):
        if not any([*self.open.end(tag)]):
            return
        self.into = [(k, d) for k, d in self.into if d <= len(self.open)]
        if self.hit is not None and len(self.open) < self.hit_depth:
            self._done()

    def handle_data(self, data):
        for key, _ in self.into:
            self.hit[key].append(data.strip())

    def _done(self):
        text = lambda key: "".join(self.hit[key] or [])
        self.found.append({"title": text("title"), "url": self.hit["url"] or "", "snippet": text("snippet")})
        self.hit, self.into = None, []

    def close(self):
        super().close()
        if self.hit is not None:
            self._done()


def _read(html: str | None, shape=None) -> _Results:
    page = _Results(shape)
    page.feed(html or "")
    page.close()
    return page


def hits(html: str | None, provider: str) -> list[dict]:
    """title, url and snippet of each container of a hit, empty where it lacks one."""
    return _read(html, RESULT_SHAPES[provider]).found


def form(html: str | None) -> dict | None:
    """Hidden fields of the first form that has both `s` and `vqd`."""
    return next((f for f in _read(html).forms if "s" in f and "vqd" in f), None)
