"""Users, roles and what they may do."""

from __future__ import annotations

import hashlib
import hmac
import os
from dataclasses import dataclass

from chronolake.schema import QueryError

# Roles and their rights on tables, users, metadata and queries.
ROLES: dict[str, frozenset[str]] = {
    "DISABLED": frozenset(),
    "READ_ONLY": frozenset({"read table", "read metadata", "write metadata", "read queries"}),
    "READ_WRITE": frozenset({"read table", "write table", "read metadata", "write metadata", "read queries"}),
    "ADMIN": frozenset({"read table", "write table", "read users", "write users", "read metadata", "write metadata", "read queries", "write queries"}),
}


@dataclass(frozen=True)
class User:
    name: str
    role: str = "DISABLED"
    salt: bytes = b""
    secret: bytes = b""


def _hash(password: str, salt: bytes) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1)


class Users:
    """The users of an engine. ``put_enabled``: whether tables may be written to at all."""

    def __init__(self, put_enabled: bool = True):
        self.by_name: dict[str, User] = {}
        self.put_enabled = put_enabled

    @staticmethod
    def _role(name: str | None) -> str:
        role = (name or "DISABLED").upper()
        if role not in ROLES:
            raise QueryError(f"Invalid role name '{name}'")
        return role

    def create(self, name: str, password: str | None, role: str | None) -> None:
        if name in self.by_name:
            raise QueryError(f"User {name} already exists")
        self.by_name[name] = self._with_password(User(name, self._role(role)), password or "")

    @staticmethod
    def _with_password(user: User, password: str | None) -> User:
        if password is None:
            return user
        salt = os.urandom(16)
        return User(user.name, user.role, salt, _hash(password, salt))

    def alter(self, name: str, password: str | None, role: str | None) -> None:
        user = self._get(name)
        if role is not None:
            user = User(name, self._role(role), user.salt, user.secret)
        self.by_name[name] = self._with_password(user, password)

    def drop(self, name: str) -> None:
        self._get(name)
        del self.by_name[name]

    def _get(self, name: str) -> User:
        if name not in self.by_name:
            raise QueryError(f"User '{name}' doesn't exists")
        return self.by_name[name]

    def login(self, name: str, password: str | None) -> User:
        """The user of that name and password; one created without a password has the empty one."""
        user = self.by_name.get(name)
        if user is None or not hmac.compare_digest(_hash(password or "", user.salt), user.secret):
            raise QueryError("Invalid user or password")
        return user

    def allowed(self, user: User | None, right: str) -> bool:
        """Whether a user has a right; without a user (an embedded engine) all rights but disabled puts are given."""
        if right == "write table" and not self.put_enabled:
            return False
        return user is None or right in ROLES[user.role]
