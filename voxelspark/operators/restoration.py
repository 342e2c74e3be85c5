"""Denoising. Iterated stencils run inside blocks whose halo is as wide as the iteration count, so
any number of steps takes one shuffle; long runs are cut into stretches."""

from __future__ import annotations

from ..functions import kernels, stencils
from ..plans.blocks import on_blocks
from ..plans.halo import map_blocks, map_slices
from ..plans.scratch import written
from ..volume import Volume

#: Steps between two exchanges of halos.
STRETCH = 16


@on_blocks(stencils.diffusion2d)
def anisotropic_diffusion2D(image: Volume, num_iter: int, delta_t: float, kappa: float, diffusion_option: int = 1) -> Volume:
    return map_slices(image, lambda a: kernels.diffusion2d(a, num_iter, delta_t, kappa, diffusion_option))


@on_blocks(stencils.diffusion3d)
def anisotropic_diffusion3D(image: Volume, num_iter: int, delta_t: float, kappa: float, diffusion_option: int = 1, flag_verbose: int = 0, gpuMemory: float = 0.4, ngpus: int = -1, block=None) -> Volume:
    """The result does not depend on the blocks."""
    while num_iter > 0:
        steps = min(num_iter, STRETCH)
        image = map_blocks(image, lambda a, n=steps: kernels.diffusion3d(a, n, delta_t, kappa, diffusion_option), steps, block=block)
        num_iter -= steps
        if num_iter:
            image = image.with_df(written(image.df, "diffusion")[0])
    return image


@on_blocks(stencils.non_local_means)
def non_local_means(image: Volume, small_window: int = 1, big_window: int = 3, h: float = 1, sigma: float = 0) -> Volume:
    """Slice by slice; ``sigma`` is accepted and has no effect."""
    return map_slices(image, lambda a: kernels.non_local_means(a, small_window, big_window, h), "float64")
