"""Step schedules as column expressions: checkpoints, update policies, learning rates, step arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def save_condition(step: Column) -> Column:
    """Whether a step is a checkpoint: ever wider intervals."""
    every = F.when(step < 20, 2).when(step < 100, 5).when(step < 500, 10).when(step < 1000, 50).when(step < 10000, 500).otherwise(10000)
    return step % every == 0


def update_policy(step: Column, ppo_steps: int, clm_steps: int, clm_first: bool, overlay: str | None) -> Column:
    place = F.pmod(step, F.lit(ppo_steps + clm_steps))
    clm = F.lit("both" if overlay == "PPO" else "CLM")
    ppo = F.lit("both" if overlay == "CLM" else "PPO")
    return F.when(place < (clm_steps if clm_first else ppo_steps), clm if clm_first else ppo).otherwise(ppo if clm_first else clm)


def anneal_policy(step: Column, total: int, decay: int, n_clm: int, n_ppo: int) -> Column:
    """CLM or PPO in closed form: the CLM part of an epoch of ``total`` steps shrinks by ``decay`` each ``n_ppo`` epochs."""
    epoch, place = F.floor(step / total), F.pmod(step, F.lit(total))
    drops = F.floor((epoch - n_clm) / n_ppo) + (1 if n_clm > 0 else 0)
    left = F.greatest(F.lit(total) - decay * drops, F.lit(0))
    return F.when((epoch < n_clm) | (place < left), "CLM").otherwise("PPO")


def cosine_wave(step: Column, max_lr: float, cycle: int, from_zero: bool = False) -> Column:
    """A full cosine a cycle."""
    return F.lit(max_lr / 2.0) * (F.cos(F.lit(2 * math.pi / cycle) * step - F.lit(math.pi if from_zero else 0.0)) + 1)


def cosine_half(step: Column, max_lr: float, cycle: int, from_zero: bool = False) -> Column:
    """Half a cosine a cycle, then a restart."""
    x = F.cos(F.lit(math.pi / cycle) * F.pmod(step, F.lit(cycle)))
    return F.lit(max_lr) * ((1 - x) if from_zero else (1 + x)) / 2


def warmup_linear(step: Column, base: float, warmup: int, total: int, floor: bool = True) -> Column:
    """Up over ``warmup`` steps, down to 0 at ``total``; below 0 after that only without the floor."""
    down = 1.0 - (step - warmup) / F.lit(float(total - warmup))
    return F.lit(base) * F.when(step < warmup, step / F.lit(float(max(warmup, 1)))).otherwise(F.greatest(F.lit(0.0), down) if floor else down)


def adaptive_lr(calls: Column, start: float, clm_lr: float, share: float = 0.32, step: float = 1.25e-7) -> Column:
    """The rate after ``calls`` updates that each add ``step`` while the other rate is above a share of this one."""
    most = math.ceil(max(clm_lr / share - start, 0.0) / step)
    return F.lit(start) + F.lit(step) * F.least(calls, F.lit(most))


def training_steps(n: Column, batch: int, epochs: int) -> Column:
    return F.floor(n / batch) * epochs


def checkpoint_interval(total: Column, parts: int = 10) -> Column:
    return F.greatest(F.lit(1), F.floor(total / parts))


def word_milestone(words_seen: Column, million: int = 1_000_000) -> Column:
    return F.concat(F.floor(words_seen / million).cast("string"), F.lit("M"))


def global_step(round_no: Column, epoch: Column, epoch_size: Column, sft_epochs: int, po_epochs: int, sft: Column) -> Column:
    """Steps done when an epoch of a round ends; the second phase of a round follows its first."""
    done = round_no * (sft_epochs + po_epochs) * epoch_size + epoch_size * (epoch + 1)
    return F.when(sft, done).otherwise(done + F.lit(sft_epochs) * epoch_size)


def epoch_checkpoint(round_no: Column, epoch: Column, sft: Column) -> Column:
    """The name of the checkpoint that an epoch leaves, null where there is none: 5M after the first epoch, then every second
    epoch of the first two rounds."""
    second = ((epoch + 1) % 2 == 0) & (round_no < 2)
    words = F.when(sft & (epoch == 0) & (round_no == 0), F.lit(5)).when(sft & second, round_no * 50 + (epoch + 1) * 5).when(~sft & second, (round_no + 1) * 50)
    return F.when(words.isNotNull(), F.concat(F.lit("checkpoint_"), words.cast("string"), F.lit("M")))


def early_checkpoint(step: Column, epoch: Column, round_no: Column, sft: Column, steps_a_million: int) -> Column:
    """The checkpoint within the first two epochs, one for each million words; null where there is none."""
    here = sft & (epoch < 2) & (round_no == 0) & (step % steps_a_million == 0) & (step > 0)
    return F.when(here, F.concat(F.lit("checkpoint_"), (epoch * 5 + F.floor(step / steps_a_million)).cast("string"), F.lit("M")))
