"""One pass over a page's HTML: title, main text, metadata, links and images."""

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pagesift import constants as K
from pagesift.functions.elements import VOID, OpenElements

DROPPED = K.DROPPED_ELEMENTS


def language_of(classes: str) -> str:
    """The language of a code block by its class names; empty if none tells it."""
    for name in classes.split():
        if known := next((p for p in K.CODE_CLASS_PREFIXES if name.startswith(p)), None):
            return name[len(known) :]
        if name in K.CODE_LANGUAGES:
            return name
    return ""


def resolved(base: str, href: str) -> tuple[str, str]:
    """The link's full URL and its host; as it stands where it can't be joined, and without a host where it can't be parsed."""
    for join in (urljoin, lambda _, own: own):
        try:
            url = join(base, href)
            return url, urlsplit(url).netloc.lower()
        except ValueError:
            continue
    return href, ""


class Code(str):
    """A fenced block, which keeps its white space."""


class Page(HTMLParser):
    """scope `body` leaves out links, images and metadata of dropped elements; `all` keeps them."""

    def __init__(self, url: str, scope: str):
        super().__init__(convert_charrefs=True)
        self.url, self.all = url, scope == "all"
        self.host = resolved(url, "")[1]
        self.open = OpenElements()
        self.dropped = 0
        self.texts = {"main": [], "article": [], "body": []}
        self.all_text: list[str] = []
        self.seen: set[str] = set()
        self.done: set[str] = set()
        self.title, self.og_title, self.meta, self.named, self.links, self.images, self.anchor = None, "", {}, {}, [], [], None
        self.block: list | None = None  # tag, language and texts of the code block under way

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        seen = self.all or not (self.dropped or tag in DROPPED)
        if tag == "meta":
            self._meta(a, seen)
        elif tag == "link" and seen and "canonical" in a.get("rel", "").lower().split():
            self.named.setdefault("canonical_url", a.get("href", ""))
        elif tag == "img" and seen and (src := a.get("src") or a.get("data-src")):
            self.images.append((resolved(self.url, src)[0], a.get("alt", "")))
        elif tag == "a":
            self._linked()  # a link that isn't closed ends where the next begins
            if seen and "href" in a:
                self.anchor = [*resolved(self.url, a["href"].strip()), a.get("title", ""), []]
        if tag in ("pre", "code") and self.block is None:
            self.block = [tag, language_of(a.get("class", "")), []]
        elif tag == "code" and self.block[0] == "pre":  # only the code inside counts
            self.block = ["pre", language_of(a.get("class", "")), []]
        if tag in VOID:
            return
        self.open.begin(tag)
        self.dropped += tag in DROPPED
        if tag in self.texts and not self.dropped:
            self.seen.add(tag)

    def _meta(self, a: dict, seen: bool) -> None:
        name, content = a.get("name") or a.get("property"), a.get("content", "")
        if a.get("property") == "og:title" and not self.og_title:
            self.og_title = content
        if seen and name and content:
            self.meta[name] = content
        if seen and a.get("name") in ("description", "keywords", "author"):  # of these the first holds
            self.named.setdefault(a["name"], content)

    def _linked(self) -> None:
        if self.anchor:
            url, host, title, parts = self.anchor
            self.links.append((url, host, "".join(x.strip() for x in parts)[:100], title))
            self.anchor = None

    def handle_endtag(self, tag):
        if tag == "a":
            self._linked()
        for closed in self.open.end(tag):
            self._left(closed)

    def _left(self, tag):
        if self.block and tag == self.block[0]:
            self._emit()
        self.dropped -= tag in DROPPED
        if tag in self.texts and tag not in self.open and self.texts[tag]:
            self.done.add(tag)

    def handle_data(self, data):
        if self.open.last() == "title" and self.title is None and data.strip():
            self.title = data.strip()
        if self.anchor and self.open.last() not in ("script", "style"):
            self.anchor[3].append(data)
        if self.block is not None:
            self.block[2].append(data)
            return
        self._add(data.strip())

    def _emit(self):
        """The code block that ends here: fenced, or between backticks if it is short or of one line outside pre; empty ones go."""
        (tag, language, parts), self.block = self.block, None
        text = "".join(parts)
        if not text.strip():
            return
        if tag == "pre":
            lines = text.split("\n")
            full = [i for i, line in enumerate(lines) if line.strip()]
            text = "\n".join(lines[full[0] : full[-1] + 1])
        elif "\n" not in text or len(text) <= 60:
            return self._add(f"`{text}`")
        self._add(Code(f"```{language}\n{text}\n```"))

    def close(self):
        super().close()
        if self.block:
            self._emit()
        self._linked()

    def _add(self, text):
        if not text or self.dropped or "title" in self.open:
            return
        self.all_text.append(text)
        for scope in self.texts:
            if scope in self.open and scope not in self.done:
                self.texts[scope].append(text)


def extract(url: str | None, html: str | None, scope: str = "body", max_chars: int = 12_000, max_links: int = 100, max_images: int = 50) -> dict:
    page = Page(url or "", scope)
    page.feed(html or "")
    page.close()
    # without main, article and body the whole page counts
    text = next((page.texts[x] for x in page.texts if x in page.seen), page.all_text)
    lines = [line for part in text for line in ([part] if isinstance(part, Code) else (" ".join(x.split()) for x in part.split("\n")))]
    content = "\n".join(x for x in lines if x)[:max_chars]
    links = [{"url": u, "host": h, "text": t, "title": title} for u, h, t, title in page.links[:max_links]]
    return {
        "title": page.title or page.og_title or "No title found",
        "content": content,
        "metadata": page.meta | page.named,
        "internal": [x for x in links if x["host"] == page.host],
        "external": [x for x in links if x["host"] != page.host],
        "images": [{"url": u, "alt": t} for u, t in page.images[:max_images]],
    }
