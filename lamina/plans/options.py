"""What a job is asked to do, checked before anything is read. Wrong options raise OptionError."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

FULL, INCREMENT, RESTORE, LIST, STATISTICS = "full", "increment", "restore", "list", "statistics"
MODES = (FULL, INCREMENT, RESTORE, LIST, STATISTICS)
LEVELS = range(5)  # 0 none, 1 fast words, 2 to 4 block compression of rising strength
STDIN = "-stdin"


class OptionError(ValueError):
    """An option that cannot be, or two that exclude each other."""


class ArchiveMissing(FileNotFoundError):
    pass


class ArchiveExists(FileExistsError):
    pass


class ChecksumError(RuntimeError):
    """A stored table does not have its checksum."""


class SkippedItems(RuntimeError):
    """Items could not be read and the job was not told to go on."""


def tidy(path: str) -> str:
    """One slash for backslashes and runs, without ./ in front or / at the end."""
    out = path.replace("\\", "/")
    while "//" in out:
        out = out.replace("//", "/")
    while out.startswith("./"):
        out = out[2:]
    return out if out == "/" else out.rstrip("/")


@dataclass(frozen=True)

class Options:
    mode: str
    archive: str
    sources: tuple[str, ...] = ()
    target: str | None = None
    set_no: int | None = None
    excludes: tuple[str, ...] = ()
    predicate: str | None = None
    level: int = 2
    block: int = 4096
    overwrite: bool = False
    skip_unreadable: bool = False
    follow_links: bool = False
    absolute: bool = False
    xattrs: str | None = None  # None, "user" or "all"
    cut: str = "aligned"
    statistics: bool = False
    wanted: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        def refuse(wrong: bool, why: str) -> None:
            if wrong:
                raise OptionError(why)

        refuse(self.mode not in MODES, f"no mode {self.mode!r}")
        refuse(not self.archive, "an archive is needed")
        refuse(self.level not in LEVELS, f"the level is one of {list(LEVELS)}")
        refuse(self.block < 64 or self.block & (self.block - 1) != 0, "the block size is a power of two from 64 on")
        refuse(self.cut not in ("aligned", "content"), "blocks are cut aligned or by content")
        refuse(self.xattrs not in (None, "user", "all"), "extended attributes: user or all")
        backup = self.mode in (FULL, INCREMENT)
        refuse(backup and not self.sources, "a backup needs sources")
        refuse(not backup and bool(self.sources), f"{self.mode} takes no sources")
        refuse(backup and (self.target is not None or bool(self.wanted)), "a backup has no target and no selection")
        refuse(STDIN in self.sources and len(self.sources) > 1, "standard input goes alone")
        refuse(STDIN in self.sources and self.mode == INCREMENT, "standard input has no increments")
        refuse(self.mode == RESTORE and self.target is None, "a restore needs a target")
        refuse(self.mode != RESTORE and bool(self.wanted), f"{self.mode} takes no selection")
        refuse(self.set_no is not None and (backup or self.set_no < 1), "a snapshot's number is 1 or more, and none for a backup")
        refuse(self.predicate is not None and not backup, "predicates choose what is backed up")
        refuse(bool(self.excludes) and not backup, "excludes choose what is backed up")
        refuse(self.overwrite and self.mode not in (FULL, RESTORE), "only a full backup or a restore overwrites")
        refuse(self.cut == "content" and self.mode not in (FULL, INCREMENT), "blocks are cut in a backup")
        full = [tidy(s) for s in self.sources]
        refuse(len(set(full)) < len(full), "a source is named twice")
        refuse(not self.absolute and any(tidy(w).startswith("/") for w in self.wanted), "selected paths are relative")

    def existing_excludes(self) -> tuple[str, ...]:
        """The excludes that name something, tidied; the others exclude nothing."""
        return tuple(tidy(e) for e in self.excludes if os.path.lexists(e))

    def never(self) -> str:
        """The archive itself, which is never part of its own backup."""
        return tidy(os.path.abspath(self.archive.removeprefix("file://")))

    def check_archive(self, exists: bool) -> None:
        if self.mode == FULL and exists and not self.overwrite:
            raise ArchiveExists(self.archive)
        if self.mode != FULL and not exists:
            raise ArchiveMissing(self.archive)


def argument_order(names: list[str]) -> list[str]:
    """Scan arguments: names without a delimiter first, otherwise as given."""
    return sorted(names, key=lambda n: "/" in tidy(n))
