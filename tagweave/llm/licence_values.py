"""Known licence sentences and the rules over them: fixed values, in plain form."""

#: (name, sentence), each once.
SENTENCES = (
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("mit-notice", "This project is licensed under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("as-is-mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "This project is licensed under the Apache License, Version 2.0."),
    ("apache-head", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-limits", "See the License for the specific language governing permissions and limitations under the License."),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3-notice", "Licensed under the GNU General Public License, version 3."),
    ("gpl3-notice", "Released under the GNU General Public License, version 3."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-details", "See the GNU General Public License for more details."),
    ("by-nc-notice", "Licensed under CC BY-NC 4.0."),
    ("by-nc-notice", "This work is licensed under CC BY-NC 4.0."),
    ("by-nc-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("by-notice", "Licensed under CC BY 4.0."),
    ("by-notice", "This work is licensed under CC BY 4.0."),
    ("by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("by-sa-notice", "Licensed under CC BY-SA 4.0."),
    ("by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-notice", "Licensed under the BSD 3-Clause License."),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("mpl-notice", "Licensed under the Mozilla Public License, Version 2.0."),
)

#: (licence, names of sentences in order); other sentences may stand between.
RULES = (
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-head", "apache-copy", "apache-limits")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", ("bsd-notice",)),
    ("CC-BY-4.0", ("by-notice",)),
    ("CC-BY-NC-4.0", ("by-nc-notice",)),
    ("CC-BY-SA-4.0", ("by-sa-notice",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant", "mit-condition", "as-is-mit")),
    ("MPL-2.0", ("mpl-notice",)),
)
