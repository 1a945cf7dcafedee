"""Syntax configuration: which rules are on, in which order, and the options. Immutable; sent to the workers as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Rule names in registration order, by chain.
CORE = ("normalize", "block", "inline", "linkify", "replacements", "smartquotes", "text_join")
BLOCK = ("table", "code", "fence", "blockquote", "hr", "list", "reference", "html_block", "heading", "lheading", "paragraph")
INLINE = ("text", "linkify", "newline", "escape", "backticks", "strikethrough", "emphasis", "link", "image", "autolink", "html_inline", "entity")
INLINE2 = ("balance_pairs", "strikethrough", "emphasis", "fragments_join")
CHAINS = {"core": CORE, "block": BLOCK, "inline": INLINE, "inline2": INLINE2}

# The options of the presets and the rules that each switches on.
_BASE_OPTIONS = {
    "maxNesting": 20, "html": True, "linkify": False, "typographer": False, "quotes": "“”‘’", "xhtmlOut": True, "breaks": False, "langPrefix": "language-",
}
_COMMONMARK = {
    "core": ("normalize", "block", "inline", "text_join"),
    "block": tuple(r for r in BLOCK if r != "table"),
    "inline": tuple(r for r in INLINE if r not in ("linkify", "strikethrough")),
    "inline2": ("balance_pairs", "emphasis", "fragments_join"),
}


def _with(base: dict, **more: tuple[str, ...]) -> dict:
    return {chain: tuple(r for r in CHAINS[chain] if r in names or r in more.get(chain, ())) for chain, names in base.items()}


_GFM = _with(_COMMONMARK, core=("linkify",), block=("table",), inline=("linkify", "strikethrough"), inline2=("strikethrough",))
PRESETS: dict[str, tuple[dict, dict]] = {
    "commonmark": (_COMMONMARK, _BASE_OPTIONS),
    "default": (dict(CHAINS), _BASE_OPTIONS | {"maxNesting": 100, "html": False, "xhtmlOut": False}),
    "zero": (
        {"core": ("normalize", "block", "inline", "text_join"), "block": ("paragraph",), "inline": ("text",), "inline2": ("balance_pairs", "fragments_join")},
        _BASE_OPTIONS | {"html": False, "xhtmlOut": False},
    ),
    "gfm-like": (_GFM, _BASE_OPTIONS | {"linkify": True}),
    "gfm-like2": (_GFM, _BASE_OPTIONS | {"linkify": True, "tasklists": True, "tasklists_editable": False, "alerts": True, "strikethrough_single_tilde": True}),
}
PRESETS["js-default"] = PRESETS["default"]


@dataclass(frozen=True)
class Syntax:
    """Active rules by chain, and options."""

    rules: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    @classmethod
    def preset(cls, name: str | dict = "commonmark", **options) -> Syntax:
        """A preset by name, or a mapping with options and components (chain: rules, and rules2 of inline); a chain that is not named has all its rules."""
        if not name:
            raise ValueError("a preset must not be empty")
        if isinstance(name, dict):
            parts = name.get("components", {})
            rules = {chain: tuple(parts.get("inline", {}).get("rules2", every) if chain == "inline2" else parts.get(chain, {}).get("rules", every)) for chain, every in CHAINS.items()}
            return cls({chain: tuple(r for r in every if r in rules[chain]) for chain, every in CHAINS.items()}, _BASE_OPTIONS | name.get("options", {}) | options)
        if name not in PRESETS:
            raise KeyError(f"no preset {name!r}; there are {', '.join(sorted(PRESETS))}")
        rules, base = PRESETS[name]
        return cls(dict(rules), base | options)

    def active(self, chain: str, rule: str) -> bool:
        return rule in self.rules[chain]

    def _switched(self, names: str | list[str], on: bool, ignore_invalid: bool) -> Syntax:
        wanted = {names} if isinstance(names, str) else set(names)
        if missing := wanted - {r for chain in CHAINS.values() for r in chain}:
            if not ignore_invalid:
                raise ValueError(f"no such rules: {', '.join(sorted(missing))}")
        keep = lambda chain, r: (r in self.rules[chain] or r in wanted) if on else (r in self.rules[chain] and r not in wanted)
        return replace(self, rules={chain: tuple(r for r in every if keep(chain, r)) for chain, every in CHAINS.items()})

    def enable(self, names: str | list[str], ignore_invalid: bool = False) -> Syntax:
        """A copy with the rules on, in every chain that has them."""
        return self._switched(names, True, ignore_invalid)

    def disable(self, names: str | list[str], ignore_invalid: bool = False) -> Syntax:
        return self._switched(names, False, ignore_invalid)

    def enable_only(self, names: str | list[str], chain: str, ignore_invalid: bool = False) -> Syntax:
        """A copy in which a chain has these rules alone."""
        wanted = {names} if isinstance(names, str) else set(names)
        if (missing := wanted - set(CHAINS[chain])) and not ignore_invalid:
            raise ValueError(f"no such rules: {', '.join(sorted(missing))}")
        return replace(self, rules=self.rules | {chain: tuple(r for r in CHAINS[chain] if r in wanted)})

    def set(self, **options) -> Syntax:
        """A copy with these options alone; all others have their common value."""
        return replace(self, options=_BASE_OPTIONS | options)

    def update(self, **options) -> Syntax:
        """A copy with these options changed."""
        return replace(self, options=self.options | options)

    def active_rules(self) -> dict[str, list[str]]:
        return {chain: list(names) for chain, names in self.rules.items()}

    @staticmethod
    def all_rules() -> dict[str, list[str]]:
        return {chain: list(names) for chain, names in CHAINS.items()}
