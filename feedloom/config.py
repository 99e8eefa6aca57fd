"""Settings of readers, relations and writers, with their defaults.

Used are: what requests send (proxy, authentication, timeout, agent), ``follow_redirects`` (``all``, ``permanent``,
``same_host`` or ``none``), ``output_encoding`` (saved feeds), ``entry_sorting_property`` (planets), ``disable_update_from_remote``,
``generator_*`` (writers), ``feed_cache`` (``parsed.open_cache``), ``timestamp_estimation_enabled``, ``url_normalization_enabled``,
``strip_comment_count``, ``max_ttl`` and ``default_ttl`` (feeds and entries).  The others are
accepted so that a set of settings can be carried over; they change nothing here, as columns are
always lazy, caches are tables, and sanitising can't be switched off.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

NAME = "feedloom"


@dataclass(frozen=True)
class Settings:
    feed_cache: str | None = None
    disable_update_from_remote: bool = False
    proxy_address: str | None = None
    proxy_port: int | None = None
    proxy_user: str | None = None
    proxy_password: str | None = None
    auth_user: str | None = None
    auth_password: str | None = None
    auth_scheme: str | None = None
    http_timeout: float | None = 30.0
    follow_redirects: str = "all"
    user_agent: str = f"{NAME}/1.0"
    generator_name: str = NAME
    generator_href: str | None = None
    tidy_enabled: bool = False
    tidy_options: tuple = ()
    lazy_parsing_enabled: bool = True
    serialization_enabled: bool = False
    idn_enabled: bool = True
    sanitization_enabled: bool = True
    sanitize_with_nofollow: bool = True
    always_strip_wrapper_elements: bool = True
    timestamp_estimation_enabled: bool = True
    url_normalization_enabled: bool = True
    entry_sorting_property: str | None = "time"
    strip_comment_count: bool = False
    tab_spaces: int = 2
    max_ttl: int = 259200
    default_ttl: int = 3600
    output_encoding: str = "utf-8"

    def with_options(self, **options) -> Settings:
        """A copy with other values; unknown names raise ValueError."""
        unknown = sorted(set(options) - {f.name for f in fields(self)})
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return replace(self, **options)


DEFAULTS = Settings()
