"""The vault as a data source: df.write.format("vault") stores notes all or not at all.

Rows have pos, filename, markdown, note_id and policy. A task puts its notes into a hidden folder of its own attempt and
tells the driver their names, not their texts. Only when all tasks are done are notes put under their names, by
the duplicate policy; a note's text is then read back and stored singly, a bounded number of them at a time, as the
server is one. Until then, and after an abort, nothing of the write is to be seen: what killed or repeated tasks left
lies in hidden folders, which commit and abort remove by the names that tasks told, and sweep() by what the server lists.

What became of each note (pos, target, action, error) is stored as the job's report, which read.format("vault") returns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from postmill.sources.web import AHEAD, VAULT_TIMEOUT, Vault, ordered, put_note

HIDDEN = ".staged"
REPORT = "pos long, target string, action string, error string"


@dataclass
class Staged(WriterCommitMessage):
    """What a task staged: its folder and (number, pos, filename, note_id, policy) of each note."""

    folder: str
    notes: list[tuple]


def vault_of(options: dict) -> Vault:
    return Vault(options["url"], options["key"], options.get("folder", ""), float(options.get("timeout", VAULT_TIMEOUT)))


class VaultWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.options, self.job = options, options.get("job") or uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        vault, folder = vault_of(self.options), f"{HIDDEN}/{self.job}/{uuid.uuid4().hex}"
        told = []
        for number, row in enumerate(iterator):
            if row["filename"]:
                vault.write(f"{folder}/{number}", row["markdown"] or "")
            told.append((number, row["pos"], row["filename"], row["note_id"], row["policy"]))
        return Staged(folder, told)

    def commit(self, messages: list[Staged | None]) -> None:
        """Notes of one name go one after another, by pos, the names side by side."""
        vault, stamp = vault_of(self.options), self.options["stamp"]
        by_name: dict[str, list[tuple]] = {}
        for message in messages:
            for number, pos, filename, note_id, policy in message.notes if message else ():
                by_name.setdefault(filename or "", []).append((pos, f"{message.folder}/{number}", note_id, policy))

        def settle(name: str) -> list[tuple]:
            done = []
            for pos, staged, note_id, policy in sorted(by_name[name], key=lambda n: (n[0] is None, n[0])):
                if not name:
                    done.append((pos, None, None, "FILENAME_INVALID"))
                else:
                    done.append((pos, *put_note(vault, name, vault.read(staged) or "", note_id, policy, stamp)))
            return done

        report = [row for rows in ordered(settle, sorted(by_name), AHEAD) for row in rows]
        vault.write(f"{HIDDEN}/{self.job}.jsonl", "".join(json.dumps(row) + "\n" for row in report))
        self.remove(vault, messages)

    def abort(self, messages: list[Staged | None]) -> None:
        self.remove(vault_of(self.options), messages)

    def remove(self, vault: Vault, messages: list[Staged | None]) -> None:
        names = [f"{m.folder}/{number}" for m in messages if m for number, _, filename, *_ in m.notes if filename]
        for _ in ordered(vault.delete, names, AHEAD):
            pass
        vault.sweep(f"{HIDDEN}/{self.job}")


class ReportReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for line in (vault_of(self.options).read(f"{HIDDEN}/{self.options['job']}.jsonl") or "").splitlines():
            yield tuple(json.loads(line))


class VaultSource(DataSource):
    """Options: url, key, folder, timeout; to write, stamp (of version names) and job (the report's name); to read, job."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return REPORT

    def writer(self, schema: StructType, overwrite: bool) -> VaultWriter:
        return VaultWriter(self.options)

    def reader(self, schema: StructType) -> ReportReader:
        return ReportReader(self.options)
