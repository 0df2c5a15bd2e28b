"""Which column plays which role."""

from dataclasses import dataclass


@dataclass(frozen=True)
class RoleSpec:
    text: str = "tran_partclr"
    categorical: tuple[str, ...] = ("tran_mode", "dr_cr_indctor", "sal_flag")
    numeric: tuple[str, ...] = ("tran_amt_in_ac",)
    label: str = "category"
    id: str = "record_id"
